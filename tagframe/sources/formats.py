"""Text formats of tagged grids as Spark sources and sinks. Cells are decoded and encoded by column expressions.

Reading gives a row per grid row, ``file, pos, id, tags``; ``operators.graph.from_rows`` makes entities of them. Large files are read by
splits (``sources.lines``). Meta of grids and columns is a table beside (``read_meta``). Lists, dicts and grids in cells become one
canonical text, whatever the format (``functions.nested``). A cell splits at commas outside quotes, back-quotes and brackets, which nest up to ``DEPTH`` deep; deeper cells are an error.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.functions import nested
from tagframe.functions.kinds import KIND, number_text, value
from tagframe.operators.lineage import written
from tagframe.sources import lines

ZINC, TRIO, JSON4, JSON3, CSV = "text/zinc", "text/trio", "application/json", "application/json;v=3", "text/csv"

_NUMBER = r"^(-?(?:INF|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)|NaN)"
_UNIT = r"([A-Za-z%_/$°²³Δℳµ\x{80}-\x{10ffff}][^\s,]*)?"
_DATE, _CLOCK, _ZONE = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d(?::\d\d(?:\.\d+)?)?", r"(?:Z|[+-]\d\d:\d\d)"
#: Levels of lists and dicts in a cell of a Zinc line.
DEPTH = 24
_QUOTED = r'"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`'


def _brackets(depth: int) -> str:
    inner = rf"[^\[\]{{}}\"`]|{_QUOTED}"
    out = rf"[\[{{](?:{inner})*+[\]}}]"
    for _ in range(depth - 1):
        out = rf"[\[{{](?:{inner}|{out})*+[\]}}]"
    return out


_CELL = rf",((?:{_QUOTED}|{_brackets(DEPTH)}|\((?:[^)\"]|{_QUOTED})*+\)|[^,\"`\[{{(])*+)"


def _double(text: Column) -> Column:
    return F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text == "NaN", F.lit(float("nan"))).otherwise(F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def _unquote(text: Column) -> Column:
    """Text of a quoted string; its escapes are JSON's, and ``\\$``."""
    return _once(text, lambda t: F.when(t.rlike(nested.PLAIN), _inside(t)).otherwise(_parsed(F.replace(t, F.lit("\\$"), F.lit("$")))))


def _inside(text: Column) -> Column:
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _parsed(text: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def _json_string(text: Column) -> Column:
    """The content of a JSON string; one without escapes needs no parser."""
    return F.when(text.rlike(nested.PLAIN), _inside(text)).otherwise(_parsed(text))


def _quote(text: Column) -> Column:
    return F.replace(_json_text(text), F.lit("$"), F.lit("\\$"))


def _nanoseconds(clock: Column) -> Column:
    part = lambda i: F.coalesce(F.get(F.split(F.split(clock, r"\.")[0], ":"), F.lit(i)).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.coalesce(F.get(F.split(clock, r"\."), F.lit(1)), F.lit("")), 9, "0").cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * F.lit(10**9).cast("long") + fraction


def _instant(stamp: Column, tz: Column) -> Column:
    zone = F.regexp_extract(stamp, rf"({_ZONE})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", F.lit(0)).otherwise(sign * (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 3600 + F.substr(zone, F.lit(5), F.lit(2)).try_cast("int") * 60))
    rest = F.substr(F.rpad(F.regexp_extract(stamp, r"\.(\d+)", 1), 9, "0"), F.lit(7), F.lit(3)).cast("short")
    return value("dateTime", ts=stamp.try_cast("timestamp"), ts_ns=rest, off_s=offset, tz=tz)


def _clock_text(ns: Column) -> Column:
    s = (ns / F.lit(10**9)).cast("long")
    rest = F.regexp_replace(F.lpad((ns % F.lit(10**9)).cast("string"), 9, "0"), "0+$", "")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two((s / 3600).cast("long")), F.lit(":"), two((s / 60).cast("long") % 60), F.lit(":"), two(s % 60), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))


def _stamp_text(v: Column) -> Column:
    local = F.timestamp_micros(F.unix_micros(v.ts) + v.off_s.cast("long") * 1_000_000)
    micros = F.lpad((F.pmod(F.unix_micros(v.ts), F.lit(1_000_000))).cast("string"), 6, "0")
    rest = F.regexp_replace(F.concat(micros, F.lpad(F.coalesce(v.ts_ns, F.lit(0)).cast("string"), 3, "0")), "0+$", "")
    size = F.abs(v.off_s)
    zone = F.when(v.off_s == 0, F.lit("Z")).otherwise(F.concat(F.when(v.off_s < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad((size / 3600).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad(((size / 60).cast("int") % 60).cast("string"), 2, "0")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), zone)


def _once(value_: Column, f) -> Column:
    """``f`` of a value that is computed once however often ``f`` looks at it, and stays out of one huge generated method."""
    return F.get(F.transform(F.array(value_), f), F.lit(0))


def zinc_decode(cell: Column) -> Column:
    """The value of a Zinc scalar, list or dict; null for none, error for text that is neither."""
    return _once(F.trim(cell), _zinc_decode)


def _zinc_decode(t: Column) -> Column:
    inner = nested.from_zinc(t, lambda x: json4_encode(_zinc_scalar(x)))
    return F.when(t.rlike(r"^[\[{]"), value(F.when(t.startswith("["), "list").otherwise("dict"), json=inner)).when(t.startswith("<<"), value("grid", json=t)).otherwise(_zinc_scalar(t))


def _zinc_scalar(t: Column) -> Column:
    got = lambda pattern, i=1: F.regexp_extract(t, pattern, i)
    number = rf"{_NUMBER}{_UNIT}$"
    return (
        F.when(t.isNull() | t.isin("", "N"), F.lit(None).cast(KIND))
        .when(t == "M", value("marker")).when(t == "NA", value("na")).when(t == "R", value("remove"))
        .when(t.isin("T", "F"), value("bool", b=t == "T"))
        .when(t.startswith('"'), value("str", str=_unquote(t)))
        .when(t.startswith("@"), value("ref", str=got(r"^@([A-Za-z0-9_:.~-]+)"), json=F.when(t.contains('"'), _unquote(got(r'^@\S+\s+(".*")$')))))
        .when(t.startswith("`"), value("uri", str=F.regexp_replace(got(r"^`(.*)`$"), r"\\(.)", "$1")))
        .when(t.startswith("^"), value("symbol", str=F.substr(t, F.lit(2))))
        .when(t.rlike(rf"^{_DATE}T"), _instant(got(rf"^({_DATE}T{_CLOCK}{_ZONE})"), F.coalesce(F.nullif(got(r"\s(\S+)$"), F.lit("")), F.lit("UTC"))))
        .when(t.rlike(rf"^{_DATE}$"), value("date", d=t.try_cast("date")))
        .when(t.rlike(rf"^{_CLOCK}$"), value("time", t_ns=_nanoseconds(t)))
        .when(t.rlike(r"^C\("), value("coord", lat=got(r"^C\(\s*(-?[\d.]+)").try_cast("double"), lng=got(r",\s*(-?[\d.]+)\s*\)$").try_cast("double")))
        .when(t.rlike(number), value("number", num=_double(got(number)), unit=F.nullif(got(number, 2), F.lit(""))))
        .when(t.rlike(r"^[A-Z]\w*\("), value("xstr", json=got(r"^(\w+)\("), str=_unquote(got(r'\(\s*(".*")\s*\)$'))))
        .otherwise(F.raise_error(F.concat(F.lit("no Zinc scalar: "), t)).cast(KIND))
    )


def zinc_encode(value_: Column) -> Column:
    """A value as Zinc; nothing for an absent one."""
    inner = lambda v: nested.to_zinc(v.json, lambda x: _once(_json4_scalar(x), _zinc_encode))
    return _once(value_, lambda v: F.when(v.kind.isin("list", "dict"), inner(v)).otherwise(_zinc_encode(v)))


def _zinc_encode(v: Column) -> Column:
    """A value as a Zinc scalar; nothing for an absent one."""
    return (
        F.when(v.isNull() | v.kind.isNull(), F.lit("")).when(v.kind == "null", F.lit("N"))
        .when(v.kind == "marker", F.lit("M")).when(v.kind == "na", F.lit("NA")).when(v.kind == "remove", F.lit("R"))
        .when(v.kind == "bool", F.when(v.b, F.lit("T")).otherwise(F.lit("F")))
        .when(v.kind == "number", F.concat(number_text(v.num), F.coalesce(v.unit, F.lit(""))))
        .when(v.kind == "str", _quote(v.str))
        .when(v.kind == "ref", F.concat(F.lit("@"), v.str, F.coalesce(F.concat(F.lit(" "), _quote(v.json)), F.lit(""))))
        .when(v.kind == "uri", F.concat(F.lit("`"), F.regexp_replace(v.str, r"([`\\])", r"\\$1"), F.lit("`")))
        .when(v.kind == "symbol", F.concat(F.lit("^"), v.str))
        .when(v.kind == "date", v.d.cast("string")).when(v.kind == "time", _clock_text(v.t_ns))
        .when(v.kind == "dateTime", F.concat(_stamp_text(v), F.when(v.tz.isNull() | (v.tz == ""), F.lit("")).otherwise(F.concat(F.lit(" "), v.tz))))
        .when(v.kind == "coord", F.concat(F.lit("C("), number_text(v.lat), F.lit(","), number_text(v.lng), F.lit(")")))
        .when(v.kind == "xstr", F.concat(v.json, F.lit("("), _quote(v.str), F.lit(")")))
        .otherwise(F.raise_error(F.concat(F.lit("no Zinc scalar for "), v.kind)))
    )


def _json_text(text: Column) -> Column:
    """A string as JSON writes it; null stays null."""
    escaped = lambda x: _once(F.to_json(F.array(x)), _inside)
    return _once(text, lambda x: F.when(x.rlike(rf"\A{nested.BARE}*+\z"), F.concat(F.lit('"'), x, F.lit('"'))).when(x.isNotNull(), escaped(x)))


def json4_decode(raw: Column) -> Column:
    """The value of a JSON text in the ``_kind`` form."""
    inner = lambda v: nested.from_json(v.json, lambda x: json4_encode(_json4_scalar(x)))
    return _canonical(_json4_scalar(raw), inner)


def _canonical(value_: Column, inner) -> Column:
    """A value whose text, if it is a list, dict or grid, is replaced by ``inner`` of it."""
    return _once(value_, lambda v: F.when(v.kind.isin("list", "dict", "grid"), value(v.kind, json=inner(v))).otherwise(v))


def _json4_scalar(raw: Column) -> Column:
    fields = lambda t: F.when(t.startswith("{"), F.from_json(t, ", ".join(f"{n} string" for n in ("_kind", "val", "unit", "dis", "tz", "lat", "lng", "type"))))
    return _once(F.trim(raw), lambda t: _once(fields(t), lambda f: _json4_decode(t, f)))


def _json4_decode(t: Column, fields: Column) -> Column:
    at = lambda k: fields[k]
    kind = at("_kind")
    return (
        F.when(t.isNull(), F.lit(None).cast(KIND)).when(t == "null", value("null"))
        .when(t.isin("true", "false"), value("bool", b=t == "true"))
        .when(t.startswith('"'), value("str", str=_json_string(t)))
        .when(t.startswith("["), value("list", json=t))
        .when(~t.startswith("{"), value("number", num=t.try_cast("double")))
        .when(kind.isin("marker", "na", "remove"), value(kind))
        .when(kind == "number", value("number", num=_double(at("val")), unit=at("unit")))
        .when(kind == "ref", value("ref", str=at("val"), json=at("dis")))
        .when(kind.isin("uri", "symbol"), value(kind, str=at("val")))
        .when(kind == "date", value("date", d=at("val").try_cast("date")))
        .when(kind == "time", value("time", t_ns=_nanoseconds(at("val"))))
        .when(kind == "dateTime", _instant(at("val"), F.coalesce(at("tz"), F.lit(""))))
        .when(kind == "coord", value("coord", lat=at("lat").try_cast("double"), lng=at("lng").try_cast("double")))
        .when(kind == "xstr", value("xstr", json=at("type"), str=at("val")))
        .when(kind == "grid", value("grid", json=t))
        .otherwise(value("dict", json=t))
    )


def json4_encode(value_: Column) -> Column:
    return _once(value_, _json4_encode)


def _json4_encode(v: Column) -> Column:
    def of(kind: str, **fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("_kind"), *[c.alias(k) for k, c in fields.items()]))

    finite = ~F.isnan(v.num) & (F.abs(v.num) != float("inf"))
    bare = F.concat(F.lit('{"_kind":"number","val":'), F.when(finite, number_text(v.num)).otherwise(F.concat(F.lit('"'), number_text(v.num), F.lit('"'))), F.coalesce(F.concat(F.lit(',"unit":'), _json_text(v.unit)), F.lit("")), F.lit("}"))
    return (
        F.when(v.kind == "null", F.lit("null")).when(v.kind.isin("marker", "na", "remove"), F.concat(F.lit('{"_kind":"'), v.kind, F.lit('"}')))
        .when(v.kind == "bool", v.b.cast("string"))
        .when(v.kind == "number", F.when(finite & v.unit.isNull(), number_text(v.num)).otherwise(bare))
        .when(v.kind == "str", _json_text(v.str))
        .when(v.kind == "ref", of("ref", val=v.str, dis=v.json)).when(v.kind == "uri", of("uri", val=v.str)).when(v.kind == "symbol", of("symbol", val=v.str))
        .when(v.kind == "date", of("date", val=v.d.cast("string"))).when(v.kind == "time", of("time", val=_clock_text(v.t_ns)))
        .when(v.kind == "dateTime", of("dateTime", val=_stamp_text(v), tz=v.tz)).when(v.kind == "coord", of("coord", lat=v.lat, lng=v.lng))
        .when(v.kind == "xstr", of("xstr", type=v.json, val=v.str)).otherwise(v.json)
    )


def json3_decode(raw: Column) -> Column:
    """The value of a JSON text in the prefix form; an unknown prefix is a plain string."""

    def inner(v: Column) -> Column:
        text = nested.from_json(v.json, lambda x: json4_encode(_json3_scalar(x)))
        return F.when(v.kind == "grid", nested.canonical(F.concat(F.lit('{"_kind":"grid",'), F.substr(text, F.lit(2))))).otherwise(text)

    return _canonical(_json3_scalar(raw), inner)


def _json3_scalar(raw: Column) -> Column:
    return _once(F.trim(raw), _json3_decode)


def _json3_decode(t: Column) -> Column:
    return (
        F.when(t.isNull(), F.lit(None).cast(KIND)).when(t == "null", value("null"))
        .when(t.isin("true", "false"), value("bool", b=t == "true"))
        .when(t.startswith("["), value("list", json=t)).when(t.startswith("{"), value(F.when(t.rlike(r'"meta"\s*:') & t.rlike(r'"cols"\s*:'), "grid").otherwise("dict"), json=t))
        .when(~t.startswith('"'), value("number", num=t.try_cast("double")))
        .otherwise(_once(_json_string(t), _json3_prefixed))
    )


def _json3_prefixed(s: Column) -> Column:
    head, rest = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(3))
    first, after = F.split(rest, " ", 2)[0], F.nullif(F.get(F.split(rest, " ", 2), F.lit(1)), F.lit(""))
    return (
        F.when(~F.coalesce(F.substr(s, F.lit(2), F.lit(1)) == ":", F.lit(False)), value("str", str=s))
        .when(s == "m:", value("marker")).when(s == "z:", value("na")).when(s == "-:", value("remove"))
        .when(head == "s:", value("str", str=rest)).when(head == "n:", value("number", num=_double(first), unit=after))
        .when(head == "r:", value("ref", str=first, json=after)).when(head == "u:", value("uri", str=rest)).when(head == "y:", value("symbol", str=rest))
        .when(head == "d:", value("date", d=rest.try_cast("date"))).when(head == "h:", value("time", t_ns=_nanoseconds(rest)))
        .when(head == "t:", _instant(first, F.coalesce(after, F.lit(""))))
        .when(head == "c:", value("coord", lat=F.split(rest, ",")[0].try_cast("double"), lng=F.get(F.split(rest, ","), F.lit(1)).try_cast("double")))
        .when(head == "x:", value("xstr", json=F.split(rest, ":", 2)[0], str=F.get(F.split(rest, ":", 2), F.lit(1))))
        .otherwise(value("str", str=s))
    )


def json3_encode(value_: Column) -> Column:
    inner = lambda v: nested.to_json3(v.json, lambda x: _once(_json4_scalar(x), _json3_encode))
    return _once(value_, lambda v: F.when(v.kind.isin("list", "dict", "grid"), inner(v)).otherwise(_json3_encode(v)))


def _json3_encode(v: Column) -> Column:
    def text(prefix: str, body: Column) -> Column:
        return _json_text(F.concat(F.lit(prefix), body))

    spaced = lambda a, b: F.concat(a, F.coalesce(F.concat(F.lit(" "), F.nullif(b, F.lit(""))), F.lit("")))
    return (
        F.when(v.kind == "null", F.lit("null")).when(v.kind == "marker", F.lit('"m:"')).when(v.kind == "na", F.lit('"z:"')).when(v.kind == "remove", F.lit('"-:"'))
        .when(v.kind == "bool", v.b.cast("string")).when(v.kind == "number", text("n:", spaced(number_text(v.num), v.unit)))
        .when(v.kind == "str", F.when(v.str.rlike("^.:"), text("s:", v.str)).otherwise(text("", v.str)))
        .when(v.kind == "ref", text("r:", spaced(v.str, v.json))).when(v.kind == "uri", text("u:", v.str)).when(v.kind == "symbol", text("y:", v.str))
        .when(v.kind == "date", text("d:", v.d.cast("string"))).when(v.kind == "time", text("h:", _clock_text(v.t_ns)))
        .when(v.kind == "dateTime", text("t:", spaced(_stamp_text(v), v.tz))).when(v.kind == "coord", text("c:", F.concat(number_text(v.lat), F.lit(","), number_text(v.lng))))
        .when(v.kind == "xstr", text("x:", F.concat(v.json, F.lit(":"), v.str))).otherwise(v.json)
    )


# --- reading ---------------------------------------------------------------------------------------


def _rows(df: DataFrame, names: Column, cells: Column, decode) -> DataFrame:
    """``file, pos, id, tags`` of rows with arrays of names and cells; of equal names the last stands."""
    pairs = F.zip_with(names, cells, lambda n, c: F.struct(n.alias("key"), decode(c).alias("value")))
    present = F.filter(pairs, lambda p: p.value.isNotNull() & p.key.isNotNull())
    last = _once(present, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q.key == p.key)))
    tags = F.map_from_entries(last)
    return df.select("file", "pos", tags.alias("tags")).withColumn("id", F.when(F.col("tags")["id"].kind == "ref", F.col("tags")["id"].str)).select("file", "pos", "id", "tags")


def _lines_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("//"))


def _whole(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """Records and heads of files in stores that only Spark reads: each file by one task."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    none = F.lit(None).cast("array<string>")
    if layout == "trio":
        rows = df.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\r", ""), r"(?m)^-{3,}[^\n]*\n?")).alias("pos", "text"))
        return rows.select("file", F.col("pos").cast("long").alias("pos"), "text", F.lit(False).alias("whole")), df.select("file", none.alias("head")).where("false")
    if layout == "json_grid":
        return df.select("file", F.lit(0).cast("long").alias("pos"), "text", F.lit(True).alias("whole")), df.select("file", F.array(F.regexp_replace("text", r'(?s)("rows"\s*:\s*\[).*$', "$1")).alias("head"))
    grids = df.where(F.trim("text") != "").select("file", _lines_of(F.col("text")).alias("lines"))
    head = F.when(F.col("lines")[0].startswith("ver:"), F.slice("lines", 1, 2)).otherwise(F.raise_error(F.lit("a Zinc grid starts with ver:")))
    rows = grids.select("file", F.posexplode(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))).alias("pos", "text"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "text", F.lit(False).alias("whole")), grids.select("file", head.alias("head"))


#: Heads of up to so many bytes in all go to every task; beyond, each record carries its own.
HEADS = 32 << 20


def records(spark: SparkSession, path: str, layout: str, split: int = lines.SPLIT) -> tuple[DataFrame, DataFrame]:
    """``file, pos, text, whole`` of records and ``file, head`` of files. Files are read by splits where their store allows it."""
    if not lines.openable(path):
        return _whole(spark, path, layout)
    lines.register(spark)
    source = spark.read.format(layout).option("splitSize", split)
    return source.load(path).drop("head"), source.option("only", "head").load(path).select("file", "head")


def _with_heads(spark: SparkSession, path: str, layout: str, split: int) -> DataFrame:
    """Records with ``head``, which files have once: sent to every task if all of them are small, else read with each record."""
    rows, heads = records(spark, path, layout, split)
    heads = written(heads, "heads")
    size = heads.agg(F.sum(F.octet_length(F.concat_ws("", "head"))) + F.sum(F.octet_length("file"))).first()[0] or 0
    if size <= HEADS:
        return rows.join(F.broadcast(heads), "file")
    if not lines.openable(path):
        return rows.join(heads, "file")
    return spark.read.format(layout).option("splitSize", split).option("head", "true").load(path)


def _cells(line: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1)


def read_zinc(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    """Grids of Zinc files, one each. Blank lines and comments are skipped; a missing cell is an absent tag. ``pos`` rises in a file."""
    df = _with_heads(spark, path, "zinc", split)
    names = F.transform(_cells(F.col("head")[1]), lambda c: F.regexp_extract(F.trim(c), r"^(\w+)", 1))
    df = df.select("file", "pos", "text", names.alias("names")).where(F.col("names")[0] != "empty")
    return _rows(df, F.col("names"), _cells(F.col("text")), zinc_decode)


def read_trio(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    """Records of Trio files: parted by dashes, ``name: value`` lines, a name alone is a marker, indented lines go on; what is no scalar is a string."""
    df = records(spark, path, "trio", split)[0].select("file", "pos", F.col("text").alias("record"))
    entry = r"(?m)^([A-Za-z]\w*)(?::[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*))?$"
    names, cells = (F.regexp_extract_all("record", F.lit(entry), i) for i in (1, 2))
    scalar = F.lit(rf'^(?:N|M|NA|R|T|F|".*"|`.*`|@\S+(?:\s+".*")?|\^\S+|{_DATE}(?:T.*)?|{_CLOCK}|C\(.*\)|{_NUMBER[1:]}{_UNIT}|[A-Z]\w*\(.*\)|\[.*\]|\{{.*\}})$')

    def decode(c: Column) -> Column:
        t = F.trim(c)
        folded = F.regexp_replace(F.regexp_replace(t, r"^\n[ \t]+", ""), r"\n[ \t]+", "\n")
        return F.when(t == "", value("marker")).when(t.contains("\n") | ~F.regexp_like(t, scalar), value("str", str=folded)).otherwise(zinc_decode(t))

    return _rows(df.where(F.size(names) > 0), names, cells, decode)


def json_rows(grids: DataFrame, decode) -> DataFrame:
    """Rows of JSON grids ``file, text``. Each cell keeps its own JSON text, so that a string stays one whatever it looks like."""
    rows = F.from_json("text", "rows array<map<string,variant>>")["rows"]
    return _json_cells(grids.select("file", F.posexplode(rows).alias("pos", "row")), decode)


def _json_cells(rows: DataFrame, decode) -> DataFrame:
    return _rows(rows, F.map_keys("row"), F.map_values("row"), lambda c: decode(F.to_json(c)))


def _read_json(spark: SparkSession, path: str, decode, split: int) -> DataFrame:
    """Grids whose rows have lines of their own are read by splits, others whole."""
    df = records(spark, path, "json_grid", split)[0]
    row = F.from_json("text", "map<string,variant>")
    by_line = df.where(~F.col("whole")).select("file", "pos", row.alias("row"))
    inside = F.from_json("text", "rows array<map<string,variant>>")["rows"]
    whole = df.where("whole").select("file", F.posexplode(inside).alias("pos", "row")).withColumn("pos", F.col("pos").cast("long"))
    return _json_cells(by_line.unionByName(whole), decode)


def read_json4(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    return _read_json(spark, path, json4_decode, split)


def read_json3(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    return _read_json(spark, path, json3_decode, split)


_META = r"""(?:^|\s)([A-Za-z_]\w*)(?::("(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`|@\S+(?: "(?:[^"\\]|\\.)*")?|\d{4}-\d\d-\d\dT\S+(?: [A-Z]\S*)?|[^\s"`]+))?(?=\s|$)"""


def read_meta(spark: SparkSession, path: str, mime: str = "text/zinc") -> DataFrame:
    """``file, column, tag, value`` of the meta of grids (column null) and of their columns. Only the files' beginnings are read."""
    if mime == ZINC:
        heads = records(spark, path, "zinc")[1].where(F.size("head") > 0)
        own = F.struct(F.lit(None).cast("string").alias("column"), F.regexp_replace(F.col("head")[0], r'^ver:"[^"]*"', "").alias("meta"))
        columns = F.transform(_cells(F.coalesce(F.col("head")[1], F.lit(""))), lambda c: F.struct(F.regexp_extract(F.trim(c), r"^(\w+)", 1).alias("column"), F.regexp_replace(F.trim(c), r"^\w+", "").alias("meta")))
        parts = heads.select("file", F.explode(F.array_prepend(columns, own)).alias("p")).select("file", "p.column", "p.meta")
        pairs = F.arrays_zip(F.regexp_extract_all("meta", F.lit(_META), 1).alias("tag"), F.regexp_extract_all("meta", F.lit(_META), 2).alias("text"))
        rows = parts.select("file", "column", F.explode(pairs).alias("x"))
        return rows.select("file", "column", F.col("x.tag").alias("tag"), F.when(F.col("x.text") == "", value("marker")).otherwise(zinc_decode(F.col("x.text"))).alias("value"))
    if mime not in (JSON4, JSON3):
        raise ValueError(f"no meta in {mime}")
    # of a grid that is one record the head is the text itself
    both, heads = records(spark, path, "json_grid")
    texts = heads.where(F.col("head").isNotNull()).select("file", F.concat(F.col("head")[0], F.lit("]}")).alias("text")).unionByName(both.where("whole").select("file", "text").join(heads.where(F.col("head").isNull()), "file", "left_semi"))
    got = texts.select("file", F.from_json("text", "meta map<string,variant>, cols array<map<string,variant>>").alias("g"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("g.meta").alias("meta")))
    nested = lambda c: F.from_json(F.to_json(c["meta"]), "map<string,variant>") if mime == JSON4 else F.map_filter(c, lambda k, _: k != "name")
    columns = F.transform("g.cols", lambda c: F.struct(c["name"].cast("string").alias("column"), nested(c).alias("meta")))
    rows = got.select("file", F.explode(F.concat(own, F.coalesce(columns, F.array().cast("array<struct<column:string,meta:map<string,variant>>>")))).alias("p"))
    rows = rows.select("file", "p.column", F.explode("p.meta").alias("tag", "v")).where(F.col("column").isNotNull() | (F.col("tag") != "ver"))
    return rows.select("file", "column", "tag", (json4_decode if mime == JSON4 else json3_decode)(F.to_json("v")).alias("value"))


READERS = {ZINC: read_zinc, TRIO: read_trio, JSON4: read_json4, JSON3: read_json3}
SUFFIXES = {".zinc": ZINC, ".trio": TRIO, ".json": JSON4, ".csv": CSV}


def read(spark: SparkSession, path: str, mime: str | None = None) -> DataFrame:
    """By MIME type, else by the file's suffix. CSV can only be written."""
    mime = mime or next((m for s, m in SUFFIXES.items() if path.endswith(s)), ZINC)
    if mime not in READERS:
        raise ValueError(f"no reader of {mime}")
    return READERS[mime](spark, path)


# --- writing ---------------------------------------------------------------------------------------


def names_of(entities: DataFrame) -> list[str]:
    """All tag names, ``id`` first: as many as there are columns in the grid."""
    names = [r[0] for r in entities.select(F.explode(F.map_keys("tags"))).distinct().orderBy("col").collect()]
    return sorted(names, key=lambda n: (n != "id", n))


def _literals(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def zinc_lines(entities: DataFrame, names: list[str]) -> DataFrame:
    line = F.array_join(F.transform(_literals(names), lambda n: zinc_encode(F.col("tags")[n])), ",")
    return entities.select(F.when(line == "", F.lit("N")).otherwise(line).alias("value"))


def csv_lines(entities: DataFrame, names: list[str]) -> DataFrame:
    quoted = F.transform(_literals(names), lambda n: F.concat(F.lit('"'), F.replace(zinc_encode(F.col("tags")[n]), F.lit('"'), F.lit('""')), F.lit('"')))
    return entities.select(F.array_join(quoted, ",").alias("value"))


def json_lines(entities: DataFrame, encode=json4_encode) -> DataFrame:
    """A row as a JSON object; names in order."""
    pairs = F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(_json_text(k), F.lit(":"), encode(F.col("tags")[k])))
    return entities.select(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("value"))


def trio_lines(entities: DataFrame) -> DataFrame:
    def entry(k: Column) -> Column:
        v = F.col("tags")[k]
        long = (v.kind == "str") & v.str.contains("\n")
        body = F.when(long, F.concat(F.lit(":\n  "), F.replace(v.str, F.lit("\n"), F.lit("\n  ")))).when(v.kind == "marker", F.lit("")).otherwise(F.concat(F.lit(": "), zinc_encode(v)))
        return F.concat(k, body)

    return entities.select(F.concat(F.array_join(F.transform(F.array_sort(F.map_keys("tags")), entry), "\n"), F.lit("\n---")).alias("value"))


def _meta_texts(meta: DataFrame | None, mime: str) -> dict[str | None, list[tuple[str, str]]]:
    """Of each column, or null for the grid, its tags in order with their encoded values: as much as the head of a file holds."""
    if meta is None:
        return {}
    encode = {ZINC: zinc_encode, JSON4: json4_encode, JSON3: json3_encode}[mime]
    rows = meta.select("column", "tag", encode(F.col("value")).alias("text"), (F.col("value.kind") == "marker").alias("marker")).orderBy("tag").collect()
    out: dict[str | None, list[tuple[str, str]]] = {}
    for r in rows:
        out.setdefault(r["column"], []).append((r["tag"], "" if r["marker"] and mime == ZINC else r["text"]))
    return out


def head_of(names: list[str], mime: str, meta: DataFrame | None = None) -> tuple[list[str], list[str], str]:
    """What stands before the rows of a file, after them, and between two."""
    if mime == CSV:
        return [",".join(f'"{n}"' for n in names)], [], ""
    about = _meta_texts(meta, mime)
    if mime == ZINC:
        tags = lambda c: "".join(f" {t}:{v}" if v else f" {t}" for t, v in about.get(c, []))
        return ['ver:"3.0"' + tags(None), ",".join(n + tags(n) for n in names) or "empty"], [], ""
    tags = lambda c: ",".join(f"{json.dumps(t)}:{v}" for t, v in about.get(c, []))
    if mime == JSON4:
        columns = [f'{{"name":{json.dumps(n)}' + (f',"meta":{{{tags(n)}}}' if n in about else "") + "}" for n in names]
        first = '{"_kind":"grid",' + (f'"meta":{{{tags(None)}}},' if None in about else "")
    else:
        columns = [f'{{"name":{json.dumps(n)}' + (f",{tags(n)}" if n in about else "") + "}" for n in names]
        first = '{"meta":{"ver":"3.0"' + (f",{tags(None)}" if None in about else "") + "},"
    return [f'{first}"cols":[{",".join(columns)}],"rows":['], ["]}"], ","


def write(entities: DataFrame, path: str, mime: str = ZINC, meta: DataFrame | None = None) -> None:
    """Every part file is a grid of its own with the same head, so parts can be read alone or together. ``meta`` is ``column, tag, value``."""
    head, tail, between = [], [], ""
    if mime in (ZINC, CSV, JSON4, JSON3):
        names = names_of(entities)
        head, tail, between = head_of(names, mime, meta)
    if mime == ZINC:
        rows = zinc_lines(entities, names)
    elif mime == CSV:
        rows = csv_lines(entities, names)
    elif mime in (JSON4, JSON3):
        rows = json_lines(entities, json4_encode if mime == JSON4 else json3_encode)
    elif mime == TRIO:
        rows = trio_lines(entities)
    else:
        raise ValueError(f"no writer of {mime}")

    def frame(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r if first and i == 0 else between + r for i, r in enumerate(texts)], pa.string())], ["value"])
            first = first and not texts
        yield pa.RecordBatch.from_arrays([pa.array(tail, pa.string())], ["value"])

    (rows.mapInArrow(frame, "value string") if head or tail else rows).write.text(path)
