"""The plan of packing is bounded by lengths, not by documents."""

from __future__ import annotations

from tagframe.llm import packing


def places(runs):
    rows = [[] for _ in range(max(r.sequence + r.count for r in runs))]
    for r in runs:
        for k in range(r.count):
            rows[r.sequence + k].append((r.offset, r.length))
    return rows


def test_runs_do_not_grow_with_equal_lengths():
    for n in (1_000, 20_001):
        runs = packing.plan({1500: n}, 4096)
        assert len(runs) < 10
        assert sum(r.count for r in runs) == n
        rows = places(runs)
        assert len(rows) == -(-n // 2)
        assert all(sorted(x) == [(0, 1500), (1500, 1500)] for x in rows[: n // 2])


def test_runs_do_not_grow_with_dominated_pairs():
    counts = {60: 5_000, 35: 5_000, 15: 6_000}
    runs = packing.plan(counts, 100)
    assert len(runs) < 20
    for length, n in counts.items():
        mine = sorted((r.first, r.count) for r in runs if r.length == length)
        assert sum(c for _, c in mine) == n
    for x in places(runs):
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 100
