"""A versioned store of entities: every write makes a new table and its change rows, and both appear at once.

Entities lie in Parquet by a hash of their id, in a fixed number of buckets; a write rewrites the buckets that it touches and no
other. Change rows (``changes``) get dense versions in the order of ids: rows are counted by partition, and a partition's first
version is the sum of the counts before it. A commit is one small JSON file that names the buckets' and the log's
files; it is put in place by a rename that fails if another writer was first, so readers see whole commits only and lost
tasks or a lost driver leave nothing but files that no commit names.

Defined cases: a batch has one write an id, more are an error, as are a missing id, ``add`` of an id that is there, ``update`` or
``remove`` of one that isn't, and a change of ``id``. An update without tags is none, whatever its id, and makes no version; an
empty batch makes no commit. ``upsert`` adds or updates. Tags given again with an equal value count as changed. Errors arise while the batch is
joined, before anything is published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagframe.functions.kinds import ENTITY, TAGS

from .changes import ChangelogGap, GraphError
from .graph import merge
from .lineage import removed, written

#: A change row: an add has ``new``, a removal ``old``, an update what was ``changed`` and, of that, what was there ``previous``ly.
LOG = T.StructType([T.StructField("version", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ref", T.StringType()), *[T.StructField(n, TAGS) for n in ("old", "new", "changed", "previous")], T.StructField("at", T.TimestampType())])


class Conflict(GraphError):
    """Another writer committed first: read the store again and repeat the write."""


def _checked(ok: Column, value: Column, message: str, ident: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(ident, F.lit("null")))))


def diff(entities: DataFrame, writes: DataFrame) -> DataFrame:
    """Entities and the writes to them, joined once: ``id, tags`` as they are afterwards (null: gone) and, where something was written, ``op, old, new, changed, previous``."""
    real = writes.where(~((F.col("op") == "update") & (F.coalesce(F.size("tags"), F.lit(0)) <= 0)) | F.col("id").isNull())
    # maps are aggregated by sorting, so rows are dealt out first: a task would else sort all that it read, as much as its file holds
    one = real.repartition("id").groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.any_value("op").alias("_op"), F.any_value(F.struct("tags")).alias("_w")).select("id", "_n", "_op", F.col("_w.tags").alias("_w"))
    both = entities.select("id", F.col("tags").alias("_old"), F.lit(True).alias("_there")).join(one, "id", "full")
    there, ident = F.coalesce(F.col("_there"), F.lit(False)), F.col("id")
    op = F.when(F.col("_op") == "upsert", F.when(there, "update").otherwise("add")).otherwise(F.col("_op"))
    good = F.when((op == "add"), ~there).when(op.isin("update", "remove"), there).otherwise(F.lit(False))
    same_id = (op != "update") | ~F.map_contains_key("_w", F.lit("id"))
    op = _checked(ident.isNotNull(), op, "an entity has no id", ident)
    op = _checked(F.col("_n") == 1, op, "a batch has one write an id", ident)
    op = _checked(F.coalesce(good, F.lit(False)), op, "an id is there already, or isn't there", ident)
    op = _checked(F.coalesce(same_id, F.lit(True)), op, "an id can't be changed", ident)
    out = both.withColumn("op", F.when(F.col("_n").isNotNull(), op))
    # an upsert without tags to an entity that is there is no write
    out = out.withColumn("op", F.when((F.col("_op") == "upsert") & (F.col("op") == "update") & (F.size("_w") <= 0), F.lit(None)).otherwise(F.col("op")))
    none = F.lit(None)
    return out.select(
        "id",
        F.when(F.col("op").isNull(), F.col("_old")).when(F.col("op") == "add", F.col("_w")).when(F.col("op") == "update", merge(F.col("_old"), F.col("_w"))).alias("tags"),
        "op",
        F.when(F.col("op") == "remove", F.col("_old")).otherwise(none).alias("old"),
        F.when(F.col("op") == "add", F.col("_w")).otherwise(none).alias("new"),
        F.when(F.col("op") == "update", F.col("_w")).otherwise(none).alias("changed"),
        F.when(F.col("op") == "update", F.map_filter("_old", lambda k, _: F.map_contains_key("_w", k))).otherwise(none).alias("previous"),
    )


def numbered(rows: DataFrame, order: str, after: int, name: str = "version") -> DataFrame:
    """Dense numbers from ``after + 1`` in the order of a column. The sort is over ranges; of each partition only its count meets the others."""
    place = F.monotonically_increasing_id()
    sorted_ = written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", place), "sorted")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row a partition
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.withColumn("_part", part).join(before, "_part").withColumn(name, F.lit(after) + F.col("_before") + row + 1).drop("_part", "_before", "_at")


@dataclass
class Store:
    spark: SparkSession
    path: str
    buckets: int = 64

    # ---- commits

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/commits/{number:020d}.json").collect()))

    def head(self) -> dict:
        """The newest commit: ``number, version, floor, buckets, log``; an empty one before the first."""
        numbers = self._commits()
        return self._read(numbers[-1]) if numbers else {"number": 0, "version": 0, "floor": 0, "buckets": {}, "log": []}

    def _publish(self, commit: dict) -> None:
        jvm = self.spark._jvm
        name = f"{self.path}/commits/{commit['number']:020d}.json"
        draft, fs = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(name), none)
        except Exception as e:
            fs.delete(draft, False)
            if "exist" in str(e).lower():
                raise Conflict(f"commit {commit['number']} is there already") from None
            raise

    # ---- reading

    def version(self) -> int:
        return self.head()["version"]

    def _load(self, paths: list[str], schema: T.StructType = ENTITY) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in sorted(paths)]) if paths else self.spark.createDataFrame([], schema)

    def entities(self, number: int | None = None) -> DataFrame:
        """``id, tags`` as of a commit, the newest unless told otherwise."""
        return self._load(list((self.head() if number is None else self._read(number))["buckets"].values()))

    def log(self, after: int = 0) -> DataFrame:
        """Changes after a version; ``ChangelogGap`` if some of those are gone. Only parts with such changes are read."""
        head = self.head()
        if head["floor"] > 0 and after < head["floor"]:
            raise ChangelogGap(f"changes after {after} are gone, the log starts after {head['floor']}")
        return self._load([p["path"] for p in head["log"] if p["last"] > after], LOG).where(F.col("version") > after)

    # ---- writing

    def bucket(self, ident: Column) -> Column:
        return F.pmod(F.xxhash64(ident), F.lit(self.buckets)).cast("int")

    def write(self, writes: DataFrame) -> int:
        """Applies a batch ``id, op, tags`` and returns the version after it."""
        head = self.head()
        batch = written(writes.select("id", "op", "tags").withColumn("_bucket", F.coalesce(self.bucket(F.col("id")), F.lit(-1))), "batch")
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most as many as buckets
        if not touched:
            return head["version"]
        old = [head["buckets"][str(b)] for b in touched if str(b) in head["buckets"]]
        joined = written(diff(self._load(old), batch.drop("_bucket")), "joined")
        # files are named by the attempt, so a try that was lost can't be mistaken for one that counted
        token = f"{head['number'] + 1:020d}-{uuid.uuid4().hex[:12]}"
        rows = joined.where("op is not null").select("op", F.col("id").alias("ref"), "old", "new", "changed", "previous")
        log = numbered(rows, "ref", head["version"]).withColumn("at", F.current_timestamp()).select(*LOG.names)
        log.write.parquet(f"{self.path}/log/{token}")
        made = self.spark.read.parquet(f"{self.path}/log/{token}").agg(F.max("version")).first()[0]
        if made is None:
            removed(batch, joined)
            there, fs = self._fs(f"{self.path}/log/{token}")
            fs.delete(there, True)
            return head["version"]
        kept = joined.where("tags is not null").select("id", "tags", self.bucket(F.col("id")).alias("bucket"))
        # a large bucket is the work of several tasks, and has as many files
        kept.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/entities/{token}")
        removed(batch, joined)
        there, fs = self._fs(f"{self.path}/entities/{token}")
        full = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(there)}
        buckets = {b: p for b, p in head["buckets"].items() if int(b) not in touched} | {str(b): f"entities/{token}/bucket={b}" for b in touched if str(b) in full}
        parts = [*head["log"], {"path": f"log/{token}", "first": head["version"] + 1, "last": made}]
        self._publish({"number": head["number"] + 1, "version": made, "floor": head["floor"], "buckets": buckets, "log": parts})
        return made

    def retain(self, rows: int = 50_000) -> int:
        """Keeps the newest ``rows`` changes; returns the version of the last one dropped. Parts that hold none of them go from the commit, their files stay for readers of older ones."""
        head = self.head()
        floor = max(head["floor"], head["version"] - rows, 0)
        if floor > head["floor"]:
            self._publish(head | {"number": head["number"] + 1, "floor": floor, "log": [p for p in head["log"] if p["last"] > floor]})
        return floor
