"""The shared folder and small helpers of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagframe.operators.lineage import folder, removed, written

__all__ = ["folder", "free_names", "removed", "small_batches", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that Spark hands a Python task at once, for the rest of the session and never above what it has set. Tasks
    themselves take their rows by bytes (``words.slices``); this only keeps Spark's own batches small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks after it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
