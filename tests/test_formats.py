import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.sources import formats as f

SCALARS = ["M", "NA", "R", "T", "F", "72", "72.5°F", "-4", "1500000", "INF", "NaN", '"a \\"b\\"\\n, c"', "@site-1", '@site-1 "A site"', "`http://x/a`", "^ahu", "2024-03-01", "12:30:45", "12:30:45.5", "2024-03-01T10:00:00Z UTC", "2024-03-01T10:00:00.25-05:00 New_York", "C(37.5,-77.25)", 'Bin("text/plain")']


def encoded(spark, texts, decode, encode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", decode(F.col("t")).alias("v")).select("i", encode(F.col("v")).alias("o")).orderBy("i").collect()]


def test_zinc_scalars_round_trip(spark):
    assert encoded(spark, SCALARS, f.zinc_decode, f.zinc_encode) == SCALARS


@pytest.mark.parametrize(("decode", "encode"), [(f.json4_decode, f.json4_encode), (f.json3_decode, f.json3_encode)])
def test_json_scalars_round_trip(spark, decode, encode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SCALARS)], "i int, t string")
    for step in (f.zinc_decode, encode, decode, f.zinc_encode):
        df = df.select("i", step(F.col("t")).alias("t")).cache()
    out = df.select("i", F.col("t").alias("o")).orderBy("i").collect()
    assert [r["o"] for r in out] == SCALARS


def test_bad_scalar_is_an_error(spark):
    with pytest.raises(Exception, match="no Zinc scalar"):
        encoded(spark, ["42 xyz ="], f.zinc_decode, f.zinc_encode)


def test_number_text(spark):
    cases = [(72.0, "72"), (1e21, "1000000000000000000000"), (1.5e-7, "0.00000015"), (12345678.25, "12345678.25"), (-0.5, "-0.5"), (1e7, "10000000")]
    df = spark.createDataFrame(cases, "x double, want string")
    assert df.where(kinds.number_text(F.col("x")) != F.col("want")).count() == 0


def entities(spark):
    rows = [("a", "M", '"A, one"', None, "72°F"), ("b", None, '"B"', "@a", None)]
    df = spark.createDataFrame(rows, "id string, site string, dis string, siteRef string, temp string")
    return df.select("id", kinds.tags(id=kinds.ref(F.col("id")), **{c: f.zinc_decode(F.col(c)) for c in ("site", "dis", "siteRef", "temp")}).alias("tags"))


@pytest.mark.parametrize("mime", [f.ZINC, f.TRIO, f.JSON4, f.JSON3])
def test_grids_round_trip(spark, tmp_path, mime):
    e = entities(spark).coalesce(1)
    f.write(e, str(tmp_path / "out"), mime)
    back = f.read(spark, str(tmp_path / "out" / "part-*"), mime).where("id is not null")
    show = lambda df: sorted((r["id"], sorted((k, v) for k, v in r["t"].items())) for r in df.select("id", F.transform_values("tags", lambda k, v: f.zinc_encode(v)).alias("t")).collect())
    assert show(back) == show(e)


def test_csv_only_writes(spark, tmp_path):
    f.write(entities(spark).coalesce(1), str(tmp_path / "out"), f.CSV)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == '"id","dis","site","siteRef","temp"' and '"@a","""A, one""","M","","72°F"' in lines
    with pytest.raises(ValueError, match="no reader"):
        f.read(spark, "x.csv")


def test_zinc_skips_comments_and_needs_a_version(spark, tmp_path):
    (tmp_path / "a.zinc").write_text('ver:"3.0"\n// note\n\nid,dis dis:"D",list\n@a,"x",[1,2]\n@b,,N\n')
    rows = {r["id"]: r["tags"] for r in f.read_zinc(spark, str(tmp_path / "a.zinc")).collect()}
    assert set(rows["a"]) == {"id", "dis", "list"} and set(rows["b"]) == {"id"} and rows["a"]["list"]["json"] == "[1,2]"
    (tmp_path / "b.zinc").write_text("id\n@a\n")
    with pytest.raises(Exception, match="starts with ver"):
        f.read_zinc(spark, str(tmp_path / "b.zinc")).collect()
