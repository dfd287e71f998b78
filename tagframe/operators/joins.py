"""Joins in which a few keys have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that stay together.
MOST = 100_000


def frequent(rows: DataFrame, on: str, most: int = MOST) -> DataFrame:
    """Keys of more than ``most`` rows and their counts: ``on, _n``. So there are fewer than a row per ``most`` rows of the table."""
    return rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)


def dealt_join(many: DataFrame, few: DataFrame, on: str, most: int = MOST, hot: DataFrame | None = None) -> DataFrame:
    """As ``many.join(few, on)``, but rows of ``many`` under a frequent key are parted by their hash, and its rows of ``few`` repeated for
    each part: no task gets all rows of a key. Neither side is sent whole to every task, however small its files are. ``hot`` is ``frequent`` of ``many``, where the caller has it."""
    hot = F.broadcast(frequent(many, on, most) if hot is None else hot)
    parts = F.floor(F.coalesce("_n", F.lit(0)) / most) + 1
    left = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts))
    right = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left.drop("_n").hint("merge").join(right.drop("_n"), [on, "_part"]).drop("_part")
