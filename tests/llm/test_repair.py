"""Conversation repair against a search over all edits, by the tensor DP over whole conversations and over ranges of long ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tagframe.llm import repair
from tagframe.llm.queries import op13_conversation_repair

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, here string, digest int"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out.values():
        conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, roles so far as the grammar sees them), ordered by cost and then by letters."""
    n = len(rows)

    def after(state, initial):  # 0 nothing, 1 s, 2 u, 3 a
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))

    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if i == n and state in (0, 3):
            return cost, letters, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (to := after(state, role[0])) is not None:
                heapq.heappush(heap, (cost + 2, letters + "I", i, to, (*lines, role + ":")))
        if i == n:
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, letters + "D", i + 1, state, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = faults[i] == "truncated"
        if role and (to := after(state, role[0])) is not None:
            heapq.heappush(heap, (cost + more, letters + "K", i + 1, to, (*lines, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if (to := after(state, new[0])) is not None:
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, to, (*lines, f"{new}:{text}")))
    raise AssertionError


def brute(rows):
    out = []
    for conv, kept in damage(rows).items():
        faults, seen = [], set()
        for _, role, text in kept:
            core = text.strip(BLANKS)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, text = cheapest(kept, faults) if kept else (0, "", "")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120, most=14):
    r, rows = random.Random(seed), []
    texts = ["Good.", "Bad", "", "  \t", "Yes!", "Well?  ", "no end, ", "日本語。", "é!", "two\nlines.", None, "x" * 3000 + "."]
    for conv in [*range(n), None]:
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "sage"])
            if r.random() < 0.7:
                role = "user" if turn % 2 == 0 else "assistant"
            text = r.choice(texts) if r.random() < 0.5 else f"text {r.randint(0, 9)}."
            rows.append((conv, r.choice([turn, turn, turn * 2, None if r.random() < 0.3 else turn]), role, text))
    rows += rows[:20]
    rows += [(9000 + i, t, "user", "a") for i in range(60) for t in range(1)]  # some lose their only row
    return rows


def found(df):
    return sorted((tuple(r[c.split()[0]] for c in repair.RESULT.split(", ")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rows = made(1)
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("longest", [1024, 5, 0])
def test_repair_matches_search(rows, longest, monkeypatch):
    monkeypatch.setattr(repair, "_STRETCH", 3)
    assert found(repair.repair(rows[1], longest=longest)) == brute(rows[0])


def test_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(repair, "_STRETCH", 4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        long = [(5, t if t % 3 else None, "user" if t % 2 == 0 else "assistant", f"turn {t // 2}." if t % 5 else "cut") for t in range(300)]
        df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string").repartition(5)
        assert found(repair.repair(df, longest=10)) == brute(long)
        assert found(repair.repair(rows[1], longest=3)) == brute(rows[0])
    finally:
        spark.conf.unset(key)


def test_large_texts_take_the_long_way(rows):
    assert found(repair.repair(rows[1], largest=1000)) == brute(rows[0])


def test_long_conversation(spark):
    r = random.Random(3)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if r.random() < 0.9 else "again.") for t in range(2500)] + [(7, 2600, "user", "same.")] * 40 + [(8, None, "user", "hello.")] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert found(repair.repair(df)) == brute(rows) == found(repair.repair(df, longest=10**6))


def test_no_rows(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_query_matches_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversation_repair(spark, sf)) == brute(rows)


def test_matrices_of_stretches_chain():
    r = np.random.default_rng(5)
    k, f = r.integers(0, 4, (12, 6)), r.integers(0, 4, (12, 6))
    whole = repair.matrices(k, f)
    halves = repair._chained(repair.matrices(k[:5], f[:5]), repair.matrices(k[5:], f[5:]))
    assert (whole == halves).all()
