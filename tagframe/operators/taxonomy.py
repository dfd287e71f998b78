"""Questions to a table of definitions (``ontology.DEF``) by joins, for catalogs of any size; ``ontology.Namespace`` answers the same for one on the driver.

Definitions are unique by symbol. Ancestors that no row defines count as supertypes but have no tags and no library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.operators.joins import MOST, dealt_join, frequent
from tagframe.operators.walks import reachable


def above(defs: DataFrame) -> DataFrame:
    """Direct supertypes: ``symbol, parent``."""
    return defs.select("symbol", F.explode("is").alias("parent")).distinct()


def closed(defs: DataFrame) -> DataFrame:
    """``symbol, ancestor, depth``, itself at depth 0, each pair once at its least depth."""
    itself = defs.select("symbol", F.col("symbol").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = reachable(above(defs).select(F.col("symbol").alias("src"), F.col("parent").alias("dst")))
    return itself.unionByName(pairs.where("src <> dst").select(F.col("src").alias("symbol"), F.col("dst").alias("ancestor"), "depth"))


def is_a(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``symbol, other`` with ``is_a``: equal, or an ancestor; an unknown symbol is only itself."""
    known = closure.select("symbol", F.col("ancestor").alias("other"), F.lit(True).alias("_is"))
    return pairs.join(known, ["symbol", "other"], "left").withColumn("is_a", F.coalesce("_is", F.lit(False)) | (F.col("symbol") == F.col("other"))).drop("_is")


def subtypes(defs: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``symbol, subtype``: direct ones, or with a closure those at any depth."""
    if closure is None:
        return above(defs).select(F.col("parent").alias("symbol"), F.col("symbol").alias("subtype"))
    return closure.where("depth > 0").select(F.col("ancestor").alias("symbol"), F.col("symbol").alias("subtype"))


def required(defs: DataFrame, closure: DataFrame) -> DataFrame:
    """``symbol, tag``: the marked ones of a definition and its supertypes."""
    marked = defs.where("mandatory").select(F.col("symbol").alias("ancestor"))
    return closure.join(marked, "ancestor").select("symbol", F.col("ancestor").alias("tag"))


def tags_for(defs: DataFrame, closure: DataFrame) -> DataFrame:
    """``symbol, tag``: tags that are used on a type or on one above it."""
    on = defs.select(F.col("symbol").alias("tag"), F.explode("tag_on").alias("ancestor"))
    return closure.join(on, "ancestor").select("symbol", "tag").distinct()


def choices(defs: DataFrame, closure: DataFrame) -> DataFrame:
    """``symbol, choice``: all subtypes of what a choice is ``of``, else its direct subtypes."""
    wide = defs.where("of is not null").select("symbol", F.col("of").alias("ancestor"))
    deep = closure.where("depth > 0").select("ancestor", F.col("symbol").alias("choice"))
    direct = subtypes(defs).join(defs.where("of is null").select("symbol"), "symbol").select("symbol", F.col("subtype").alias("choice"))
    return wide.join(deep, "ancestor").select("symbol", "choice").unionByName(direct)


def kind(symbol: Column, is_: Column) -> Column:
    """By direct supertypes, the first that applies."""
    has = lambda *names: F.arrays_overlap(is_, F.array(*[F.lit(n) for n in names]))
    return F.when(has("lib"), "lib").when(has("choice"), "choice").when(has("entity"), "entity").when(has("val", "scalar"), "val").when(has("feature"), "feature").when(symbol.contains("-"), "conjunct").otherwise("marker")


def without_lib(defs: DataFrame, lib: str) -> DataFrame:
    """The catalog as if a library had never been loaded; one that others build on can't go."""
    rest = defs.where(~F.col("lib").eqNullSafe(F.lit(lib)))
    if not above(rest).join(defs.where(F.col("lib") == lib).select(F.col("symbol").alias("parent")), "parent", "left_semi").isEmpty():
        raise ValueError(f"others build on {lib}")
    return rest


def listing(defs: DataFrame, search: str) -> DataFrame:
    """``list, name``: all definitions, their libraries, and the symbols that contain a text."""
    row = lambda df, name: df.select(F.lit(name).alias("list"), F.col("name"))
    names = defs.select(F.col("symbol").alias("name"))
    libs = defs.where("lib is not null").select(F.col("lib").alias("name")).distinct()
    return row(names, "def").unionByName(row(libs, "lib")).unionByName(row(names.where(F.col("name").contains(search)), "search"))


def fitting(entities: DataFrame, needs: DataFrame, most: int = MOST) -> DataFrame:
    """``id, symbol`` where an entity has every tag that a type requires (``required``), whatever the tag holds. Types that require none fit everything and don't come."""
    names = entities.select("id", F.map_keys("tags").alias("_tags")).select("id", "_tags", F.explode("_tags").alias("tag"))
    # a type meets the entities that have the rarest of its tags, which are looked at for the others
    hot = frequent(names, "tag", most)
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)), "tag")).tag
    types = needs.join(F.broadcast(hot), "tag", "left").groupBy("symbol").agg(F.collect_set("tag").alias("_needs"), rarest.alias("tag"))
    met = dealt_join(names, types, "tag", most, hot)
    return met.where(F.forall("_needs", lambda t: F.array_contains("_tags", t))).select("id", "symbol")


def inherited_slots(bases: DataFrame, slots: DataFrame) -> DataFrame:
    """``spec, slot, ...`` of specs ``spec, base`` with ``spec, slot, ...``: a slot of the nearest spec up the chain stands for those of its name above."""
    up = reachable(bases.where("base is not null").select(F.col("spec").alias("src"), F.col("base").alias("dst"))).where("src <> dst")
    chain = bases.select("spec", F.col("spec").alias("_of"), F.lit(0).alias("depth")).unionByName(up.select(F.col("src").alias("spec"), F.col("dst").alias("_of"), "depth"))
    rest = [c for c in slots.columns if c not in ("spec", "slot")]
    all_ = chain.join(slots.withColumnRenamed("spec", "_of"), "_of")
    best = all_.groupBy("spec", "slot").agg(F.min_by(F.struct(*rest, F.col("_of").alias("of")), "depth").alias("_s"))
    return best.select("spec", "slot", *[F.col(f"_s.{c}").alias(c) for c in rest], F.col("_s.of").alias("of"))
