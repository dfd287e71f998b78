"""Traversal of entities by their reference tags. All of it is joins on ids; edges are a table of ``src, tag, dst``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagframe.functions.filters import Node
from tagframe.operators.lineage import written
from tagframe.plans.compile import Branches, values, where_dynamic

# Entity classes, the most specific first.
CLASSES = ["sensor", "cmd", "sp", "ahu", "vav", "boiler", "chiller", "meter", "point", "equip", "room", "floor", "zone", "space", "site", "weather", "device", "network"]


def triples(entities: DataFrame) -> DataFrame:
    """A row per tag: ``id, tag, value``."""
    return entities.select("id", F.explode(F.map_entries("tags")).alias("e")).select("id", F.col("e.key").alias("tag"), F.col("e.value").alias("value"))


def edges(entities: DataFrame) -> DataFrame:
    """References at the top level, but for ``id``: ``src, tag, dst``, dangling ones too."""
    return triples(entities).where("value.kind = 'ref' and tag <> 'id'").select(F.col("id").alias("src"), "tag", F.col("value.str").alias("dst"))


def refs_from(links: DataFrame, src: str, tag: str | None = None) -> DataFrame:
    out = links.where(F.col("src") == src)
    return out if tag is None else out.where(F.col("tag") == tag)


def refs_to(links: DataFrame, dst: str, tag: str | None = None) -> DataFrame:
    """A row per edge: a source with two references to the target comes twice."""
    out = links.where(F.col("dst") == dst)
    return out if tag is None else out.where(F.col("tag") == tag)


def children(entities: DataFrame, ident: str) -> DataFrame:
    return refs_to(edges(entities), ident).select(F.col("src").alias("id")).join(entities, "id")


def equip_points(entities: DataFrame, ident: str, test: Node | None = None) -> DataFrame:
    """Children that are points and that meet a condition; it follows no references."""
    out = children(entities, ident).where(F.map_contains_key("tags", "point"))
    return out if test is None else where_dynamic(out, test, resolve=False)


def ref_chain(entities: DataFrame, ident: str, tags: list[str]) -> DataFrame:
    """Entities met when following a list of references, up to the first that leads nowhere: ``step, id, tags``."""
    at = entities.where(F.col("id") == ident).select(F.col("tags").alias("_at"))
    out = None
    for step, tag in enumerate(tags, 1):
        value = F.col("_at")[tag]
        found = at.select(F.when(value.kind == "ref", value.str).alias("id")).join(entities, "id")
        row = found.select(F.lit(step).alias("step"), "id", "tags")
        out = row if out is None else out.unionByName(row)
        at = found.select(F.col("tags").alias("_at"))
    return out


def site_for(entities: DataFrame | Branches) -> DataFrame:
    """``id, site_id``: itself if a site; else what ``siteRef`` names, null if that is missing; else that of ``equipRef``."""
    ref = lambda t: F.when(F.col(t).kind == "ref", F.col(t).str)
    rows = [b.select("site", "siteRef", "equipRef") for b in entities.all] if isinstance(entities, Branches) else [values(entities, "site", "siteRef", "equipRef")]
    e = reduce(DataFrame.unionByName, rows).select("id", F.col("site").isNotNull().alias("_is"), ref("siteRef").alias("_s"), ref("equipRef").alias("_e"))
    equip = values(entities, "siteRef").select(F.col("id").alias("_e"), ref("siteRef").alias("_es"))
    ids = e.select(F.col("id").alias("_want"), F.col("id").alias("_found"))
    want = F.when(F.col("_is"), F.col("id")).when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("_es"))
    return e.join(equip, "_e", "left").withColumn("_want", want).join(ids, "_want", "left").select("id", F.col("_found").alias("site_id"))


def hierarchy(spark, links: DataFrame, root: str, max_depth: int = 50) -> DataFrame:
    """Nodes below a root along reversed edges: ``id, parent, depth``, each once, at its least depth and of
    the parents there under the smallest. A loop of joins, one per level; cycles end it."""
    up = links.select(F.col("dst").alias("parent"), F.col("src").alias("id")).distinct()
    level = spark.createDataFrame([(root, None, 0)], "id string, parent string, depth int")
    levels = [level]  # each is written once
    for depth in range(1, max_depth + 1):
        found = level.select(F.col("id").alias("parent")).join(up, "parent").groupBy("id").agg(F.min("parent").alias("parent"))
        level = found.join(reduce(DataFrame.unionByName, levels).select("id"), "id", "left_anti").select("id", "parent", F.lit(depth).alias("depth"))
        level = written(level, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def dangling(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges to ids that no entity has."""
    return links.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "tag", "dst")


def classify(has: dict[str, Column] | Column) -> Column:
    """The first class tag that is there, whatever it holds. ``has``: conditions by tag, or a map of tags."""
    test = (lambda t: has.get(t, F.lit(False))) if isinstance(has, dict) else (lambda t: F.map_contains_key(has, t))
    return F.coalesce(*[F.when(test(t), F.lit(t)) for t in CLASSES])


def read_ids(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of ``pos, id`` in the order asked for; unknown ids come with null tags."""
    return ids.join(entities, "id", "left").orderBy("pos")


def columns_of(entities: DataFrame) -> DataFrame:
    """All tag names, sorted: the columns of a result grid."""
    return entities.select(F.explode(F.map_keys("tags")).alias("tag")).distinct().orderBy("tag")


def from_rows(rows: DataFrame, order: str) -> DataFrame:
    """Entities of grid rows ``id, tags`` and an order: rows without id are skipped, the first of equal ids wins."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.where("id is not null").withColumn("_n", rank).where("_n = 1").select("id", "tags")


def display_name(entities: DataFrame) -> DataFrame:
    """``dis`` if a string, else the id's own display name."""
    dis, ident = F.col("tags")["dis"], F.col("tags")["id"]
    return entities.select("id", F.coalesce(F.when(dis.kind == "str", dis.str), ident.json).alias("dis"))


def nav(entities: DataFrame, ident: str | None = None) -> DataFrame:
    """A level of navigation, ``id, dis, nav_id``: sites at the top, then what refers to an entity, each once."""
    rows = entities.where(F.map_contains_key("tags", F.lit("site"))) if ident is None else children(entities, ident).dropDuplicates(["id"])
    return display_name(rows).select("id", "dis", F.col("id").alias("nav_id"))


def merge(old: Column, new: Column) -> Column:
    """Tags overwritten by others; a ``remove`` value deletes one."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, F.map_filter(new, lambda k, v: v.kind != "remove"))
