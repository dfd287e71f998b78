"""Time series of points: ``point_id, ts, ord, val``. Written rows append; the last written of an instant wins."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAP = 1_000_000
WRITE_ROWS = 100_000


def parse_range(text: str, today: dt.date | None = None) -> tuple[dt.datetime, dt.datetime]:
    """``today``, ``yesterday``, ``D`` or ``D,D`` as two inclusive instants, to whole seconds."""
    today = today or dt.datetime.now(dt.UTC).date()
    text = text.strip().strip('"')
    named = {"today": today, "yesterday": today - dt.timedelta(days=1)}
    days = [named[text]] * 2 if text in named else [dt.date.fromisoformat(x.strip()) for x in text.split(",")]
    if not 1 <= len(days) <= 2 or not re.fullmatch(r"[\w, -]+", text):
        raise ValueError(f"no range: {text}")
    return dt.datetime.combine(days[0], dt.time()), dt.datetime.combine(days[-1], dt.time(23, 59, 59))


def read(history: DataFrame, point: object, start: dt.datetime | Column | None = None, end: dt.datetime | Column | None = None) -> DataFrame:
    """Rows of a point between two inclusive bounds, instants or columns without references, in order of time; an unknown point has none."""
    out = history.where(F.col("point_id") == point)
    out = out if start is None else out.where(F.col("ts") >= F.lit(start).cast(history.schema["ts"].dataType))
    out = out if end is None else out.where(F.col("ts") <= F.lit(end).cast(history.schema["ts"].dataType))
    return out.orderBy("ts")


def last_wins(history: DataFrame) -> DataFrame:
    """Of rows of one point and instant the one written last. An aggregate, so that a hot point is combined before it is shuffled."""
    rest = [c for c in history.columns if c not in ("point_id", "ts")]
    best = history.groupBy("point_id", "ts").agg(F.max_by(F.struct(*rest), F.col("ord")).alias("_r"))
    return best.select("point_id", "ts", *[F.col(f"_r.{c}").alias(c) for c in rest])


def capped(history: DataFrame, cap: int = CAP, period: str = "day") -> DataFrame:
    """The newest rows of each point, by time and then by order of writing.

    Rows are counted by point and period; periods that are wholly inside the cap stay as they are, and only in the one that
    crosses it rows are ranked. So no task has to take more of a hot point than one of its periods.
    """
    part = F.date_trunc(period, F.col("ts").cast("timestamp"))
    sizes = history.groupBy("point_id", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    newer = F.sum("_n").over(Window.partitionBy("point_id").orderBy(F.col("_part").desc_nulls_last())) - F.col("_n")
    room = sizes.select(F.col("point_id").alias("_p"), F.col("_part").alias("_q"), (F.lit(cap) - newer).alias("_room"), "_n").where("_room > 0")
    rows = history.withColumn("_part", part).join(room, F.col("point_id").eqNullSafe(F.col("_p")) & F.col("_part").eqNullSafe(F.col("_q"))).drop("_p", "_q")
    n = F.row_number().over(Window.partitionBy("point_id", "_part").orderBy(F.col("ts").desc(), F.col("ord").desc()))
    across = rows.where(F.col("_n") > F.col("_room")).withColumn("_i", n).where(F.col("_i") <= F.col("_room"))
    return rows.where(F.col("_n") <= F.col("_room")).select(*history.columns).unionByName(across.select(*history.columns))


def _bucket(point: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(point.cast("string")), F.lit(buckets)).cast("int")


def save(history: DataFrame, path: str, buckets: int = 256, rows_a_file: int = 4_000_000) -> None:
    """History as files by a hash of the point, sorted by point and time; large buckets have several, each of a range, so a hot point is the work of many tasks."""
    spread = history.withColumn("bucket", _bucket(F.col("point_id"), buckets)).repartitionByRange("bucket", "point_id", "ts").sortWithinPartitions("bucket", "point_id", "ts")
    spread.write.option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").mode("append").parquet(path)


def read_saved(spark: SparkSession, path: str, point: object, start: dt.datetime | Column | None = None, end: dt.datetime | Column | None = None, buckets: int = 256) -> DataFrame:
    """``read`` of saved history: one bucket's folder, and of its files the row groups that may hold the point and the times."""
    every = spark.read.parquet(path)
    return read(every.where(F.col("bucket") == _bucket(F.lit(point), buckets)), point, start, end).drop("bucket")


def write(history: DataFrame, rows: DataFrame, cap: int = CAP) -> DataFrame:
    """History after a write; at most 100,000 rows at once."""
    if rows.limit(WRITE_ROWS + 1).count() > WRITE_ROWS:
        raise ValueError(f"more than {WRITE_ROWS} rows in one write")
    return write_all(history, rows, cap)


def write_all(history: DataFrame, rows: DataFrame, cap: int = CAP) -> DataFrame:
    """History as any number of writes leave it. The last written wins and the cap drops only what is older than rows that stay, so one pass does what one write after the other does."""
    return capped(last_wins(history.unionByName(rows)), cap)


def counts(history: DataFrame) -> DataFrame:
    return history.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
