"""Tag values: one struct for every kind, and columns that build it.

Recursive kinds (list, dict, grid) are kept as canonical JSON text (``nested``); they are deeply equal when their comparable texts are.
``ts`` holds microseconds and ``ts_ns`` the rest of a nanosecond time; equality of times counts the zone's name, order doesn't.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagframe.functions.nested import comparable

KIND = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("str", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("d", T.DateType()),
        T.StructField("t_ns", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_ns", T.ShortType()),
        T.StructField("off_s", T.IntegerType()),
        T.StructField("tz", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("json", T.StringType()),
    ]
)
TAGS = T.MapType(T.StringType(), KIND)
ENTITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", TAGS)])

#: Kinds that have an order.
ORDERED = ("number", "str", "date", "time", "dateTime")
#: Which fields make two values of a kind equal.
EQUAL_BY = {
    "number": ("num", "unit"), "str": ("str",), "uri": ("str",), "symbol": ("str",), "ref": ("str",), "bool": ("b",), "date": ("d",), "time": ("t_ns",),
    "dateTime": ("ts", "ts_ns", "tz"), "coord": ("lat", "lng"), "xstr": ("str", "json"),
    "null": (), "marker": (), "na": (), "remove": (),
}
TYPE_NAMES = {"null": "Null", "marker": "Marker", "na": "NA", "remove": "Remove", "bool": "Bool", "number": "Number", "str": "Str", "ref": "Ref", "uri": "Uri", "symbol": "Symbol", "date": "Date", "time": "Time", "dateTime": "DateTime", "coord": "Coord", "xstr": "XStr", "list": "List", "dict": "Dict", "grid": "Grid"}


@functools.lru_cache(maxsize=4)
def _absent(context: SparkContext | None) -> dict[str, Column]:
    """Each field without a value, made once a context: most fields of most values are these."""
    return {f.name: F.lit(None).cast(f.dataType.simpleString()).alias(f.name) for f in KIND.fields}


def value(kind: Column | str, **fields: Column) -> Column:
    """A value of a kind with the given fields."""
    named = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | fields
    absent = _absent(SparkContext._active_spark_context)
    return F.struct(*[named[f.name].cast(f.dataType.simpleString()).alias(f.name) if f.name in named else absent[f.name] for f in KIND.fields])


def marker() -> Column:
    return value("marker")


def number(num: Column, unit: Column | str | None = None) -> Column:
    return value("number", num=num, unit=F.lit(unit) if unit is None or isinstance(unit, str) else unit)


def string(text: Column) -> Column:
    return value("str", str=text)


def ref(ident: Column, dis: Column | None = None) -> Column:
    return value("ref", str=ident, **({} if dis is None else {"json": dis}))


def boolean(flag: Column) -> Column:
    return value("bool", b=flag)


def date_time(ts: Column, tz: str = "UTC") -> Column:
    return value("dateTime", ts=ts, ts_ns=F.lit(0), off_s=F.lit(0), tz=F.lit(tz))


def literal(fields: dict) -> Column:
    return value(fields["kind"], **{k: F.lit(v) for k, v in fields.items() if k != "kind"})


def tags(**values: Column) -> Column:
    """A map of tags; null values are absent tags."""
    pairs = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.v.kind.isNotNull()))


def type_name(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPE_NAMES.items()])


def number_text(num: Column) -> Column:
    """A number as plain decimal text: no exponent, no ``.0``."""
    raw = num.cast("string")
    mantissa = F.regexp_extract(raw, r"^-?([\d.]+)E", 1)
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=\d)0+$", "")
    large = F.when(F.length(digits) <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    plain = F.when(raw.contains("E"), F.concat(F.when(num < 0, F.lit("-")).otherwise(F.lit("")), F.when(exponent >= 0, large).otherwise(small))).otherwise(F.regexp_replace(raw, r"\.0$", ""))
    return F.when(F.isnan(num), F.lit("NaN")).when(num == float("inf"), F.lit("INF")).when(num == float("-inf"), F.lit("-INF")).otherwise(plain)


def display(v: Column) -> Column:
    """A value as a person reads it."""
    return (
        F.when(v.kind == "number", F.concat(number_text(v.num), F.coalesce(v.unit, F.lit(""))))
        .when(v.kind == "bool", F.when(v.b, "true").otherwise("false"))
        .when(v.kind == "date", v.d.cast("string"))
        .when(v.kind == "dateTime", v.ts.cast("string"))
        .when(v.kind == "marker", F.lit("✓"))
        .when(v.kind == "ref", F.coalesce(v.json, F.concat(F.lit("@"), v.str)))
        .otherwise(F.coalesce(v.str, v.json, F.lit("")))
    )


def ref_is_valid(ident: Column) -> Column:
    """Whether an id has characters that a reference may have, and at least one."""
    return F.coalesce(ident.rlike(r"\A[A-Za-z0-9_:.~-]+\z"), F.lit(False))


def _same_zero(a: Column, b: Column) -> Column:
    """Bitwise equality of numbers: NaN equals NaN, 0.0 is not -0.0."""
    return (a == b) & ((a != 0) | (a.cast("string") == b.cast("string")))


def equal(a: Column, b: Column) -> Column:
    """Deep equality of two values; never null for values that are there."""
    deep = F.when(a.kind.isin("list", "dict", "grid"), comparable(a.json).eqNullSafe(comparable(b.json)))
    same = [deep, *[F.when(a.kind == k, _fields_equal(a, b, by)) for k, by in EQUAL_BY.items()]]
    return (a.kind == b.kind) & F.coalesce(*same, F.lit(False))


def _fields_equal(a: Column, b: Column, by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in by:
        out = out & (F.coalesce(_same_zero(a[f], b[f]), F.lit(False)) if f in ("num", "lat", "lng") else a[f].eqNullSafe(b[f]))
    return out


def less(a: Column, b: Column, or_equal: bool = False) -> Column:
    """Order of two values of one ordered kind; numbers need equal units; else false."""
    def pick(x: Column, y: Column) -> Column:
        return x <= y if or_equal else x < y

    return (a.kind == b.kind) & F.coalesce(
        F.when(a.kind == "number", a.unit.eqNullSafe(b.unit) & ~F.isnan(a.num) & ~F.isnan(b.num) & pick(a.num, b.num)),
        F.when(a.kind == "str", pick(a.str, b.str)),
        F.when(a.kind == "date", pick(a.d, b.d)),
        F.when(a.kind == "time", pick(a.t_ns, b.t_ns)),
        F.when(a.kind == "dateTime", (a.ts < b.ts) | ((a.ts == b.ts) & pick(F.coalesce(a.ts_ns, F.lit(0)), F.coalesce(b.ts_ns, F.lit(0))))),
        F.lit(False),
    )
