"""Types of entities: a taxonomy of definitions, what each makes mandatory, and checks of entities against it.

Definitions are a table ``symbol, lib, is (array), tag_on (array), of, mandatory``, or a small list of the same; a
catalog of a few thousand stays on the driver, while entities are always checked by joins or columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.operators.graph import dangling, edges, triples
from tagframe.operators.walks import reachable

DEF = "symbol string, lib string, is array<string>, tag_on array<string>, of string, mandatory boolean"


@dataclass
class Namespace:
    defs: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def of(cls, rows) -> Namespace:
        """From rows with the columns of ``DEF``; of equal symbols the last stands."""
        return cls({r["symbol"]: {"symbol": r["symbol"], "lib": r["lib"], "is": list(r["is"] or []), "tag_on": list(r["tag_on"] or []), "of": r["of"], "mandatory": bool(r["mandatory"])} for r in rows})

    @classmethod
    def read(cls, records: DataFrame) -> Namespace:
        """From records of Trio files, rows with ``tags``, that hold a ``def``; others are not definitions. The library is the ``lib`` tag's."""
        tag = lambda t: F.col("tags")[t]
        symbols = lambda t: F.when(tag(t).kind == "list", F.regexp_extract_all(tag(t).json, F.lit(r"\^([A-Za-z][\w:.-]*)"), 1)).when(tag(t).kind == "symbol", F.array(tag(t).str))
        name = lambda t: F.when(tag(t).kind.isin("symbol", "str"), F.regexp_replace(tag(t).str, "^lib:", ""))
        rows = records.where(tag("def").kind == "symbol").select(
            tag("def").str.alias("symbol"), name("lib").alias("lib"), symbols("is").alias("is"), symbols("tagOn").alias("tag_on"), name("of").alias("of"),
            F.map_contains_key("tags", F.lit("mandatory")).alias("mandatory"), "file", "pos",
        )
        return cls.of(rows.orderBy("file", "pos").collect())  # a catalog of a few thousand

    def supertypes(self, symbol: str) -> list[str]:
        """Nearest first; cycles end."""
        out, level = [], [symbol]
        while level:
            level = [p for s in level for p in self.defs.get(s, {}).get("is", [])]
            level = [p for p in dict.fromkeys(level) if p not in out and p != symbol]
            out += level
        return out

    def is_a(self, symbol: str, other: str) -> bool:
        return symbol == other or other in self.supertypes(symbol)

    def subtypes(self, symbol: str, deep: bool = False) -> list[str]:
        direct = sorted(s for s, d in self.defs.items() if symbol in d["is"])
        return direct if not deep else sorted(s for s in self.defs if s != symbol and symbol in self.supertypes(s))

    def mandatory_tags(self, symbol: str) -> tuple[str, ...]:
        """The marked ones of a definition and its supertypes; none for an unknown one."""
        return tuple(sorted(s for s in [symbol, *self.supertypes(symbol)] if self.defs.get(s, {}).get("mandatory"))) if symbol in self.defs else ()

    def required(self) -> dict[str, tuple[str, ...]]:
        """Mandatory tags of every definition, for the filter compiler."""
        return {s: self.mandatory_tags(s) for s in self.defs}

    def tags_for(self, symbol: str) -> list[str]:
        types = {symbol, *self.supertypes(symbol)}
        return sorted(s for s, d in self.defs.items() if types & set(d["tag_on"]))

    def choices(self, symbol: str) -> list[str]:
        of = self.defs.get(symbol, {}).get("of")
        return self.subtypes(of, deep=True) if of else self.subtypes(symbol)

    def kind(self, symbol: str) -> str:
        """By direct supertypes, the first that applies."""
        above = self.defs[symbol]["is"]
        for names, kind in ((("lib",), "lib"), (("choice",), "choice"), (("entity",), "entity"), (("val", "scalar"), "val"), (("feature",), "feature")):
            if set(names) & set(above):
                return kind
        return "conjunct" if "-" in symbol else "marker"

    def without_lib(self, lib: str) -> Namespace:
        """The catalog as if a library had never been loaded."""
        return Namespace({s: d for s, d in self.defs.items() if d["lib"] != lib})

    def search(self, text: str) -> list[str]:
        return sorted(s for s in self.defs if text in s)

    def libs(self) -> list[str]:
        return sorted({d["lib"] for d in self.defs.values() if d["lib"]})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(d[k] for k in ("symbol", "lib", "is", "tag_on", "of", "mandatory")) for _, d in sorted(self.defs.items())], DEF)

    def required_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, t) for s, ts in sorted(self.required().items()) for t in ts], "symbol string, tag string")


def conjunct_parts(symbol: Column) -> Column:
    return F.split(symbol, "-")


def closure(defs: DataFrame, max_depth: int = 100) -> DataFrame:
    """``symbol, ancestor, depth`` of a table of definitions, itself at depth 0, each pair once at its least depth."""
    itself = defs.select("symbol", F.col("symbol").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = reachable(defs.select(F.col("symbol").alias("src"), F.explode("is").alias("dst")), max_depth)
    return itself.unionByName(pairs.where("src <> dst").select(F.col("src").alias("symbol"), F.col("dst").alias("ancestor"), "depth"))


def fits(tags: Column, required: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in required:
        out = out & F.map_contains_key(tags, t)
    return out


def missing(tags: Column, required: tuple[str, ...]) -> Column:
    """The mandatory tags that an entity lacks, as an array."""
    return F.filter(F.array(*[F.lit(t) for t in required]).cast("array<string>"), lambda t: ~F.map_contains_key(tags, t))


def validate(entities: DataFrame, namespace: Namespace) -> DataFrame:
    """Issues ``id, issue, tag, detail``: tags that a marker of the entity makes mandatory and that it lacks, and references to nothing."""
    spark = entities.sparkSession
    every = triples(entities)
    need = every.where("value.kind = 'marker'").join(namespace.required_table(spark).withColumnRenamed("tag", "need"), F.col("tag") == F.col("symbol")).select("id", F.col("tag").alias("detail"), F.col("need").alias("tag"))
    lacking = need.join(every.select("id", "tag"), ["id", "tag"], "left_anti").select("id", F.lit("missing_marker").alias("issue"), "tag", "detail")
    lost = dangling(edges(entities), entities.select("id")).select(F.col("src").alias("id"), F.lit("dangling_ref").alias("issue"), "tag", F.col("dst").alias("detail"))
    return lacking.unionByName(lost)


def summary(entities: DataFrame, namespace: Namespace) -> DataFrame:
    """One row: ``total, valid, with_errors, untyped, with_warnings, coverage``. Dangling references are no errors here."""
    spark = entities.sparkSession
    known = namespace.required_table(spark).select(F.col("symbol").alias("tag")).distinct()
    markers = triples(entities).where("value.kind = 'marker'")
    typed = markers.join(known, "tag", "left_semi").select("id").distinct().withColumn("typed", F.lit(1))
    wrong = validate(entities, namespace).where("issue = 'missing_marker'").select("id").distinct().withColumn("wrong", F.lit(1))
    rows = entities.select("id").join(typed, "id", "left").join(wrong, "id", "left")
    n, t, w = F.count(F.lit(1)), F.count("typed"), F.count("wrong")
    return rows.agg(n.alias("total"), (n - w - (n - t)).alias("valid"), w.alias("with_errors"), (n - t).alias("untyped"), F.lit(0).cast("long").alias("with_warnings"), F.coalesce(F.try_divide(t, n), F.lit(0.0)).alias("coverage"))
