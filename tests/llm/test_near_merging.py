"""Near-duplicates in lists that hold many components: parted by further pairs, and dealt out around the largest one."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, prose

from tagframe.llm import near_dedup


def corpus():
    """A group around one text, single texts that share most of it, and pairs among those."""
    r, shared, out = random.Random(3), prose(50, 60), []
    for i in range(40):
        w = (shared + " " + prose(51, 40)).split()
        w[r.randrange(len(w))] = f"edit{i % 25}"
        out.append(" ".join(w))
    for i in range(35):
        own = prose(200 + i, 22).split()
        for _ in range(r.choice([1, 1, 2])):
            w = list(own)
            w[r.randrange(len(w))] += "x"
            out.append(shared + " " + " ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "fan"), [(8, 2)])
def test_wide_lists(spark, monkeypatch, block, fan):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FAN", fan)
    parted = []
    kept = near_dedup._parted
    monkeypatch.setattr(near_dedup, "_parted", lambda *a: parted.append(a[-1]) or kept(*a))
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = near_dedup.near_groups(df, 80).collect()
    assert sorted(map(str, brute_components(texts, 80))) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    assert parted  # lists had more others than a block takes


def test_coordinates_are_bounded(spark):
    with pytest.raises(ValueError):
        near_dedup.near_groups(spark.createDataFrame(corpus()[:2], "doc_id long, text string"), coordinates=256)


def test_large_sets_that_share_nothing(spark, tmp_path):
    r = np.random.default_rng(7)
    texts = [" ".join(f"{x:03x}" for x in r.integers(0, 4096, 20_000).tolist()) for _ in range(400)]
    pq.write_table(pa.table({"doc_id": range(400), "text": texts}), tmp_path / "d.parquet", row_group_size=50)
    rows = near_dedup._signatures_of(spark.read.parquet(str(tmp_path / "d.parquet")), "doc_id", "text", 5, 64).collect()
    sigs = np.stack([np.frombuffer(row["sig"], np.uint32) for row in rows])
    assert sigs.shape == (400, 64)
    assert sum(400 - len(np.unique(sigs[:, k])) for k in range(64)) == 0  # no two of them meet in a list


@pytest.mark.parametrize(("block", "cell"), [(64, 4), (8, 3)])
def test_dealt_lists(spark, monkeypatch, block, cell):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CELL", cell)
    texts, parted, kept = corpus(), [], near_dedup._parted
    monkeypatch.setattr(near_dedup, "_parted", lambda wide, *a: parted.append(a[-1]) or kept(wide, *a))
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 80).collect()
    assert sorted(map(str, brute_components(texts, 80))) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    assert bool(parted) == (block == 8)


def test_rows_of_lists_are_not_broadcast(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    signed = near_dedup._signatures_of(docs, "doc_id", "text", 5, 64).select(F.col("doc_id").alias("node"), "sig")
    pairs = near_dedup.written(signed.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("b")), "pairs")
    wide = near_dedup.written(signed.select(F.lit(7).cast("long").alias("token"), "node", F.lit(0).alias("rank")), "wide")
    nodes = near_dedup.written(signed, "nodes")
    joined = [near_dedup._with_texts(docs, wide, "doc_id", "text"), near_dedup._parted(wide, nodes, None, 64, 30), near_dedup._screen(pairs, nodes, 64, 34)]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in joined]
    assert all("SortMergeJoin" in plan for plan in plans)
    assert not any("BroadcastHashJoin" in plan for plan in plans[:2])
