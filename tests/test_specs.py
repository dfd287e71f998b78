"""Walks of references in specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators import specs


def test_reached_follows_long_chains_and_ends_at_cycles(spark):
    last = 53
    rows = [(f"n{i}", f"n{i + 1}" if i < last else None) for i in range(last + 1)] + [("a", "b"), ("b", "a")]
    df = spark.createDataFrame(rows, "id string, next string").coalesce(1)
    entities = df.select("id", F.when(F.col("next").isNotNull(), kinds.tags(nextRef=kinds.ref(F.col("next")))).otherwise(kinds.tags(end=kinds.marker())).alias("tags"))
    got = sorted(tuple(x) for x in specs.reached(entities, "nextRef+").collect())
    assert got == sorted([(f"n{i}", f"n{j}") for i in range(last) for j in range(i + 1, last + 1)] + [(x, y) for x in "ab" for y in "ab"])
    assert specs.reached(entities, "nextRef").count() == last + 2
