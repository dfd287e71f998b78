"""Clusters by Hamerly's bounds against plain rounds in Python's integers."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from tagframe.llm import clusters
from tagframe.llm.queries import op12_hamerly, oracle_sql

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, distance string"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, rounds, dims, scale=256, seed="2:"):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    kept = [x for x in kept if all(abs(c) <= clusters.LIMIT for c in x[1])]
    pack = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(kept, key=lambda x: (hashlib.sha256(f"{seed}{'' if x[0] is None else x[0]}".encode()).hexdigest(), pack(x[1])))[:k]
    centers = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        at = [min(range(len(centers)), key=lambda c: (far(v, centers[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centers)):
                mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
                if mine:
                    centers[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    d = [far(v, centers[a]) for (_, v), a in zip(kept, at, strict=True)]
    per = {c: sum(x for x, a in zip(d, at, strict=True) if a == c) for c in set(at)}
    return sorted(((i, a, x, per[a], sum(d), hashlib.sha256(",".join(map(str, centers[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(0, 0.3, 6) + (i % 7)).tolist()) for i in range(400)]
    rows += [(500 + i, [0.25 * (i % 3)] * 6) for i in range(60)]  # ties and repeats
    rows += [(7, rows[7][1]), (None, [1.0] * 6), (None, [2.0] * 6), (800, None), (801, [1.0] * 5), (802, [1.0] * 7), (803, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (804, [math.nan] * 6), (805, [math.inf, 1, 1, 1, 1, 1]), (806, []), (807, [1e300] * 6), (808, [-400_000.0, 9.0, 1.0, 2.0, 3.0, 4.0])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, "clash", "clash", "clash") for i, e in rows], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize(("k", "rounds"), [(12, 5), (1, 3), (600, 2), (5, 0)])
def test_clusters_match_plain_rounds(rows, vectors, k, rounds):
    assert got(clusters.cluster(vectors, k=k, rounds=rounds, dims=6)) == brute(rows, k, rounds, 6)


def test_bounds_spare_scans():
    r = np.random.default_rng(2)
    v = np.concatenate([r.integers(-30, 30, (500, 8)) + 1000 * i for i in range(6)])
    centers = np.stack([v[500 * i] for i in range(6)])
    cluster, upper, lower, scanned = clusters.assign(v, np.full(len(v), -1), np.zeros(len(v)), np.zeros(len(v)), clusters.Round.of(centers, None))
    assert scanned == len(v)
    moved = np.stack([v[cluster == i].sum(axis=0) // (cluster == i).sum() for i in range(6)])
    again, _, _, scanned = clusters.assign(v, cluster, upper, lower, clusters.Round.of(moved, centers))
    assert scanned == 0 and (again == cluster).all()


def test_large_components_are_scanned_exactly():
    v = np.array([[clusters.LIMIT, -clusters.LIMIT], [clusters.LIMIT - 1, 5]], np.int64)
    best, near, second = clusters.scan(v, np.array([[clusters.LIMIT - 1, 5], [clusters.LIMIT, -clusters.LIMIT + 1]], np.int64))
    assert best.tolist() == [1, 0] and near.tolist() == [1, 0]
    assert second.tolist() == [1 + (clusters.LIMIT + 5) ** 2, 1 + (clusters.LIMIT + 4) ** 2]


def test_no_vectors(spark):
    assert clusters.cluster(spark.createDataFrame([], SCHEMA), dims=6).count() == 0


def test_query_matches_sql_and_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = got(op12_hamerly(spark, sf))
    assert found == brute(rows, 40, 5, 64)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}'")
    df = db.execute(oracle_sql()["op12_hamerly"])
    names = [x[0] for x in df.description]
    assert found == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in df.fetchall()), key=str)
