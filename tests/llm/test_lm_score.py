"""How the language model of ``op10_lm_score`` learns, against plain loops."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tagframe.llm import lm_score, words

TEXTS = ["north south east west " * 3 + ("new york" if i % 2 else "old town") for i in range(40)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def voc(train):
    return lm_score.vocabulary(train, lm_score._counts(train))


def features(texts, v):
    r, n, _ = lm_score._ranks(pa.array(texts), v.keys, v.ranks)
    with np.errstate(over="ignore"):
        return lm_score._features(r, n, v), r, n


def test_words_and_hashes():
    texts = pa.array([" A b\x0bB ", None, "", "É\x1cé a", "x" * 50 + " " + "x" * 51])
    got = words.ascii_words(texts)
    want = [(t or "").encode().lower().split() for t in texts.to_pylist()]
    assert got.sizes.tolist() == [len(w) for w in want]
    assert [got.distinct[int(i)].as_py().encode() for i in got.ids] == [w for ws in want for w in ws]
    r = random.Random(1)
    many = sorted({"".join(r.choice("ab\0é") for _ in range(r.randint(1, 45))) for _ in range(5000)})
    h = words.hashes(pa.array(many))
    assert len(set(h.tolist())) == len(many)
    assert (words.hashes(pa.array(many).slice(1000, 50)) == h[1000:1050]).all() and (words.hashes(pa.array(many[::-1])) == h[::-1]).all()


def test_slices_bound_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + ["b" * 100, None, "c"])], ["text"])
    got = [x.num_rows for x in words.slices([b], 0, 30)]
    assert got == [3, 3, 1, 1, 2] and sum(got) == b.num_rows


def test_company_counts_three_words_on_both_sides(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    v = lm_score.vocabulary(df, lm_score._counts(df))
    a, b, c, d, _ = features(["a b c d"], v)[1]
    got = {(x["rank"], x["common"]): x["n"] for x in lm_score._company(df, v.keys, v.ranks).collect()}
    assert got[(a, d)] == got[(d, a)] == got[(b, c)] == got[(c, b)] == 2


def test_vocabulary_keeps_whole_levels_of_counts(spark):
    df = spark.createDataFrame([(1, "a a a a b b b c c d d e")], "doc_id long, text string")
    counts = lm_score._counts(df)
    assert sorted(lm_score.vocabulary(df, counts).counts.tolist()) == [1, 2, 2, 3, 4]  # the end counts once, e is rare
    v = lm_score.vocabulary(df, counts, 3)  # c and d don't both fit
    assert sorted(v.counts.tolist()) == [1, 3, 4] and (v.tokens, v.words) == (13, 6)


def test_chances_add_up_to_one(train, voc):
    halves = lm_score.Halves(voc)
    w = lm_score.fit(train, voc, halves, rows=1 << 10, cells=1 << 12)
    f, r, _ = features(["north new york old unseen west"], voc)
    every = np.arange(len(voc.keys) + 1)  # the last is the class of rarer words and the unknown one
    with np.errstate(over="ignore"):
        for k in range(f.shape[1]):
            p = np.exp(lm_score.log_chances(w, halves, voc, np.repeat(f[:, k : k + 1], len(every), axis=1), every))
            assert abs(p.sum() - 1) < 1e-4
            if k == 2:  # after "new": history separates words of one count
                york, town = features(["york town"], voc)[1][:2]
                assert voc.counts[york] == voc.counts[town] and p[york] > 2 * p[town]


def test_halves_lead_to_each_word_once(voc):
    halves = lm_score.Halves(voc)
    ways = collections.defaultdict(list)
    for t, h, s in zip(*(x.tolist() for x in halves.ways(np.arange(len(voc.keys)))), strict=True):
        ways[t].append((h, s))
    for c in range(len(voc.totals) - 1):
        mine = [tuple(ways[w]) for w in np.flatnonzero(voc.classes[:-1] == c)]
        assert len(set(mine)) == len(mine) and abs(sum(2.0 ** -len(m) for m in mine) - 1) < 1e-9


def test_a_round_equals_plain_loops(train, voc):
    """Sums of two rounds, and the step between them, token by token."""
    halves, rows, cells = lm_score.Halves(voc), 1 << 6, 1 << 8
    context = train.sparkSession.sparkContext
    shared = [context.broadcast(voc), context.broadcast(halves)]
    f, ranks, _ = features(TEXTS, voc)
    width = len(voc.totals)

    def loops(w):
        expected, seen, times = np.zeros(rows * width + cells), np.zeros(rows * width + cells), np.zeros(rows + cells)
        for k, r in enumerate(ranks):
            row = [int(x) & rows - 1 for x in f[:, k]]
            z = [voc.prior[c] + sum(w.classes[x, c] for x in row) for c in range(width)]
            total = sum(map(math.exp, z))
            for x in row:
                times[x] += 1
                seen[x * width + voc.classes[r]] += 1
                for c in range(width):
                    expected[x * width + c] += math.exp(z[c]) / total
            for _, half, side in zip(*(x.tolist() for x in halves.ways(np.array([r]))), strict=True):
                at = []
                for template, x in enumerate(f[:, k].tolist()):
                    h = (x >> 32 ^ half * int(lm_score._GOLD32) % (1 << 32)) * int(lm_score._ODD32) % (1 << 32)
                    at.append(template * (cells // 8) + (h >> 32 - 5))
                p = 1 / (1 + math.exp(-halves.prior[half] - sum(w.cells[x] for x in at)))
                for x in at:
                    expected[rows * width + x] += p
                    seen[rows * width + x] += side
                    times[rows + x] += 1
        return expected, seen, times

    w = lm_score.Weights.none(voc, rows, cells)
    first = lm_score.sums_of(train, *shared, None, (rows, width, cells))
    want = loops(w)
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-3) for a, b in zip(first, want, strict=True))
    w = lm_score.stepped(w, *first, 10.0)
    x = int(np.argmax(want[2][rows:]))  # one cell by hand
    n, met, p = want[2][rows + x], want[1][rows * width + x], want[0][rows * width + x] / want[2][rows + x]
    q = (met + 10 * p) / (n + 10)
    assert abs(w.cells[x] - (math.log(q / (1 - q)) - math.log(p / (1 - p))) / 6) < 1e-3
    second = lm_score.sums_of(train, *shared, context.broadcast(w), (rows, width, cells))[0]
    assert np.allclose(second, loops(w)[0], rtol=1e-3, atol=1e-2)


def test_partitions_do_not_matter(train, voc):
    halves = lm_score.Halves(voc)
    a, b = (lm_score.fit(df, voc, halves, rows=1 << 10, cells=1 << 12) for df in (train, train.repartition(5)))
    assert np.allclose(a.classes, b.classes, atol=1e-4) and np.allclose(a.cells, b.cells, atol=1e-4)
    assert np.abs(a.cells).max() > 0.05
