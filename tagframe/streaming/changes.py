"""Change logs as streams: a folder of Parquet rows with versions, read by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tagframe.functions.kinds import TAGS
from tagframe.operators.changes import affected

CHANGE = T.StructType([T.StructField("version", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ref", T.StringType()), *[T.StructField(n, TAGS) for n in ("old", "new", "changed", "previous")]])


def changes(spark: SparkSession, path: str, after: int = 0, files_a_batch: int = 1000) -> DataFrame:
    """A stream of changes after a version. The checkpoint of the query that reads it keeps the place."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_a_batch).parquet(path).where(F.col("version") > after)


def notify(stream: DataFrame, watches: DataFrame, sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls ``sink(batch_id, frame)`` with ``watch_id, ids`` of the watches that each micro-batch touches."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(n, affected(watches, df))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def keep_history(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends history rows ``point_id, ts, ord, val`` under their batch; a batch run again replaces itself. Readers take ``history.last_wins``, so late rows need no watermark."""

    def save(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(stream: DataFrame, value: str = "val") -> DataFrame:
    """Running newest value of each point, by time and then by order of writing."""
    return stream.groupBy("point_id").agg(F.max_by(F.struct("ts", "ord", value), F.struct("ts", "ord")).alias("last"))
