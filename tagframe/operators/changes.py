"""Versioned changes to entities, and watches on them.

A log has ``version, op, ref, old, new, changed, previous`` (maps of tags). Versions come from one writer, a change each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagframe.functions import kinds

from .graph import merge

LOG_ROWS = 50_000
POLL_ROWS = 10_000
WATCHES, WATCHES_A_USER, IDS_A_WATCH, IDS_A_USER = 100, 20, 1_000, 5_000


class ChangelogGap(Exception):
    """The log no longer reaches back to the version asked for: take everything anew."""


class GraphError(ValueError):
    pass


def since(log: DataFrame, version: int, floor: int = 0) -> DataFrame:
    """Changes after a version. ``floor``: the version of the last change that was dropped from the log."""
    if floor > 0 and version < floor:
        raise ChangelogGap(f"changes after {version} are gone, the log starts after {floor}")
    return log.where(F.col("version") > version)


def poll_rows(log: DataFrame, version: int, floor: int = 0, rows: int = POLL_ROWS) -> tuple[DataFrame, bool]:
    """At most ``rows`` changes, oldest first, and whether there are more."""
    found = since(log, version, floor).orderBy("version").limit(rows + 1)
    return found.limit(rows), found.count() > rows


def retained(log: DataFrame, rows: int = LOG_ROWS) -> tuple[DataFrame, int]:
    """The newest changes, and the version of the last one dropped (0: none). Versions have no gaps, so a bound does it."""
    top = log.agg(F.max("version")).first()[0] or 0
    floor = max(0, top - rows)
    return log.where(F.col("version") > floor), floor


def replay(log: DataFrame) -> DataFrame:
    """The entities that a log leaves: ``id, tags``. Of each entity only the changes after its last add or
    remove count; their tags are combined by an aggregate, newest first."""
    start = F.max(F.when(F.col("op").isin("add", "remove"), F.col("version"))).over(Window.partitionBy("ref"))
    rows = log.withColumn("_start", start).where(F.col("version") >= F.coalesce("_start", F.lit(0)))
    tags = rows.select("ref", "version", "op", F.explode_outer(F.when(F.col("op") == "add", F.col("new")).when(F.col("op") == "update", F.col("changed"))).alias("tag", "value"))
    gone = tags.where("op = 'remove'").select("ref").distinct()
    newest = tags.where("tag is not null").groupBy("ref", "tag").agg(F.max_by("value", "version").alias("value")).where("value.kind <> 'remove'")
    return newest.join(gone, "ref", "left_anti").groupBy(F.col("ref").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("tags"))


def add(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Entities with new ones; an id that is missing or there already is an error."""
    if not rows.where("id is null").isEmpty():
        raise GraphError("an entity has no id")
    if not rows.groupBy("id").count().where("count > 1").isEmpty() or not rows.join(entities.select("id"), "id", "left_semi").isEmpty():
        raise GraphError("an id is there already")
    return entities.unionByName(rows)


def update(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities with changed tags, a row of ``changes`` per id; ids can't change, unknown ones are an error, no change is none."""
    real = changes.where(F.size("tags") > 0)
    if not real.where(F.map_contains_key("tags", "id")).isEmpty():
        raise GraphError("an id can't be changed")
    if not real.join(entities.select("id"), "id", "left_anti").isEmpty():
        raise GraphError("an entity isn't there")
    return entities.join(real.select("id", F.col("tags").alias("_new")), "id", "left").select("id", F.when(F.col("_new").isNotNull(), merge(F.col("tags"), F.col("_new"))).otherwise(F.col("tags")).alias("tags"))


def remove(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities without some; references to those stay."""
    if not ids.select("id").join(entities.select("id"), "id", "left_anti").isEmpty():
        raise GraphError("an entity isn't there")
    return entities.join(ids.select("id"), "id", "left_anti")


def upsert(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows merged into entities that are there, added otherwise; rows without id are skipped."""
    new = rows.where("id is not null").select("id", F.col("tags").alias("_new"))
    both = entities.join(new, "id", "full")
    return both.select("id", F.when(F.col("tags").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("tags")).otherwise(merge(F.col("tags"), F.col("_new"))).alias("tags"))


def point_write(entities: DataFrame, writes: DataFrame) -> DataFrame:
    """``id, val, level`` written to writable points: sets ``curVal`` and ``writeLevel`` (1 to 17, 17 if null)."""
    level = F.coalesce("level", F.lit(17))
    if not writes.where((level < 1) | (level > 17)).isEmpty():
        raise GraphError("a level is 1 to 17")
    open_ids = entities.where(F.map_contains_key("tags", "writable")).select("id")
    if not writes.join(open_ids, "id", "left_anti").isEmpty():
        raise GraphError("a point isn't writable")
    return update(entities, writes.select("id", F.create_map(F.lit("curVal"), F.col("val"), F.lit("writeLevel"), kinds.number(level.cast("double"))).alias("tags")))


def subscribe(watches: DataFrame, watch: str, owner: str, ids: DataFrame, version: int, limited: bool = True) -> DataFrame:
    """A new watch ``watch_id, owner, id, last_version``, within the limits. Those guard the memory of a service; a table of watches may do without."""
    if limited:
        sizes = watches.groupBy("owner", "watch_id").agg(F.count(F.lit(1)).alias("n")).collect()  # 100 watches at most
        mine = [r["n"] for r in sizes if r["owner"] == owner]
        n = ids.limit(IDS_A_WATCH + 1).count()
        if len(sizes) >= WATCHES or len(mine) >= WATCHES_A_USER or n > IDS_A_WATCH or sum(mine) + n > IDS_A_USER:
            raise GraphError("too many watches or ids")
    return watches.unionByName(ids.distinct().select(F.lit(watch).alias("watch_id"), F.lit(owner).alias("owner"), "id", F.lit(version).cast("long").alias("last_version")))


def watch_ids(watches: DataFrame, watch: str, owner: str, ids: DataFrame, limited: bool = True) -> DataFrame:
    """More ids for a watch, those it has already aside, within the limits if any; they start at its version."""
    mine = watches.where((F.col("watch_id") == watch) & (F.col("owner") == owner))
    version = mine.agg(F.min("last_version")).first()[0]
    if version is None:
        raise GraphError("no such watch")
    new = ids.select("id").distinct().join(mine.select("id"), "id", "left_anti")
    if limited:
        n, there = new.limit(IDS_A_WATCH + 1).count(), mine.count()
        if there + n > IDS_A_WATCH or watches.where(F.col("owner") == owner).count() + n > IDS_A_USER:
            raise GraphError("too many watches or ids")
    return watches.unionByName(new.select(F.lit(watch).alias("watch_id"), F.lit(owner).alias("owner"), "id", F.lit(version).cast("long").alias("last_version")))


def unwatch_ids(watches: DataFrame, watch: str, owner: str, ids: DataFrame) -> DataFrame:
    """A watch without some of its ids; ids that it doesn't have are none."""
    gone = ids.select("id", F.lit(watch).alias("watch_id"), F.lit(owner).alias("owner"))
    return watches.join(gone, ["watch_id", "owner", "id"], "left_anti")


def unsubscribe(watches: DataFrame, watch: str, owner: str) -> DataFrame:
    """Watches without one; one that isn't there is none."""
    return watches.where(~((F.col("watch_id") == watch) & (F.col("owner") == owner)))


def totals(watches: DataFrame) -> DataFrame:
    """``owner, watches, ids``: how many each owner has, an id of two watches counting twice; what the limits are held against."""
    return watches.groupBy("owner").agg(F.count_distinct("watch_id").alias("watches"), F.count(F.lit(1)).alias("ids"))


def watched(watches: DataFrame) -> DataFrame:
    """The ids that any watch has, each once."""
    return watches.select("id").distinct()


def poll(watches: DataFrame, watch: str, owner: str, log: DataFrame, entities: DataFrame, floor: int = 0) -> DataFrame:
    """Current rows of watched entities that changed since the watch's last version; all of them after a gap. Removed ones don't come."""
    mine = watches.where((F.col("watch_id") == watch) & (F.col("owner") == owner))
    row = mine.agg(F.min("last_version")).first()[0]
    if row is None:
        raise GraphError("no such watch")
    wanted = mine.select("id")
    if not (floor > 0 and row < floor):
        wanted = wanted.join(log.where(F.col("version") > row).select(F.col("ref").alias("id")), "id", "left_semi")
    return entities.join(wanted, "id", "left_semi")


def affected(watches: DataFrame, changes: DataFrame) -> DataFrame:
    """Which watches a batch of changes touches: ``watch_id, ids``. A watch has a bounded number of ids."""
    return watches.join(changes.select(F.col("ref").alias("id")).distinct(), "id").groupBy("watch_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
