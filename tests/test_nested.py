import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds, nested
from tagframe.functions.filters import FilterError, dict_of, list_of, literal, num, ref_to, tag
from tagframe.plans.compile import where_dynamic
from tagframe.sources import formats as f

#: Zinc as written, and as it is written again.
VALUES = {
    "[]": "[]",
    "{}": "{}",
    "[1, 2.50kW, -3,]": "[1,2.5kW,-3]",
    '["a, ]b", "q \\"x\\" {", `http://x/[a]`, ^ahu]': '["a, ]b","q \\"x\\" {",`http://x/[a]`,^ahu]',
    '[@a "A, a", @b.c, M, NA, R, T, F, N]': '[@a "A, a",@b.c,M,NA,R,T,F,N]',
    "[2024-03-01, 12:30:45.5, 2024-03-01T10:00:00.25-05:00 New_York, C(37.5,-77.25), INF]": "[2024-03-01,12:30:45.5,2024-03-01T10:00:00.25-05:00 New_York,C(37.5,-77.25),INF]",
    '[Bin("text/plain"), Span("a)b")]': '[Bin("text/plain"),Span("a)b")]',
    '{site dis:"B:c" area:35000ft² geo:{lat:1 lng:-2 at}}': '{area:35000ft²,dis:"B:c",geo:{at,lat:1,lng:-2},site}',
    "[[1,[2,[3,[4,{a:[5,{b}]}]]]],[]]": "[[1,[2,[3,[4,{a:[5,{b}]}]]]],[]]",
    "{a:N b:NA}": "{a:N,b:NA}",
}


def column(spark, texts, *steps):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for step in steps:
        df = df.select("i", step(F.col("t")).alias("t"))
    return [r["t"] for r in df.orderBy("i").collect()]


def test_zinc_round_trip(spark):
    assert column(spark, VALUES, f.zinc_decode, f.zinc_encode) == list(VALUES.values())


@pytest.mark.parametrize(("encode", "decode"), [(f.json4_encode, f.json4_decode), (f.json3_encode, f.json3_decode)])
def test_round_trip_through_json(spark, encode, decode):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, t string")
    for step in (f.zinc_decode, encode, decode, f.zinc_encode):
        df = df.select("i", step(F.col("t")).alias("t")).cache()
    assert [r["t"] for r in df.orderBy("i").collect()] == list(VALUES.values())


def test_plain_strings_are_rewritten_without_looking_at_them(spark):
    """Scalars that are an error: only other values than strings without escapes may need them."""
    bad = lambda x: F.raise_error(F.lit("looked at")).cast("string")
    zinc, canonical = ['[{s:"O" r:"N x"}, { r:"N", s:"O" },["a" "b"] ]', '{a:"" b:["$"]}'], ['[{"r":"N x","s":"O"},{"r":"N","s":"O"},["a","b"]]', '{"a":"","b":["$"]}']
    assert column(spark, zinc, lambda t: nested.from_zinc(t, bad)) == canonical
    assert column(spark, canonical, lambda t: nested.to_json3(t, bad)) == canonical == column(spark, canonical, lambda t: nested.from_json(t, bad))
    assert column(spark, canonical[:1], lambda t: nested.to_zinc(t, bad)) == ['[{r:"N x",s:"O"},{r:"N",s:"O"},["a","b"]]']
    for text in ('["a:b"]', '["\\n"]', "[1]"):
        with pytest.raises(Exception, match="looked at"):
            column(spark, [text], lambda t: nested.to_json3(t, bad))


def test_signs_inside_strings_stay(spark):
    v = {'[", " "]{" "a:b" ":" "" "x"]': '[", ","]{","a:b",":","","x"]', '{a:"b:" c:"{d:" e : "$"}': '{a:"b:",c:"{d:",e:"\\$"}', '["m:" "n:1" "s:" "_kind"]': '["m:","n:1","s:","_kind"]'}
    assert column(spark, v, f.zinc_decode, f.zinc_encode) == list(v.values())
    assert column(spark, v, f.zinc_decode, f.json3_encode, f.json3_decode, f.zinc_encode) == list(v.values())


def test_forms_of_json(spark):
    v = ['{site dis:"x" n:[1kW,@a "A"]}']
    assert column(spark, v, f.zinc_decode, f.json4_encode) == ['{"dis":"x","n":[{"_kind":"number","unit":"kW","val":1},{"_kind":"ref","dis":"A","val":"a"}],"site":{"_kind":"marker"}}']
    assert column(spark, v, f.zinc_decode, f.json3_encode) == ['{"dis":"x","n":["n:1 kW","r:a A"],"site":"m:"}']


def test_grids_between_the_forms_of_json(spark):
    grid = '{"_kind":"grid","meta":{"dis":"x"},"cols":[{"name":"a"}],"rows":[{"a":{"_kind":"number","val":1,"unit":"kW"}}]}'
    three = column(spark, [grid], f.json4_decode, f.json3_encode)
    assert three == ['{"cols":[{"name":"a"}],"meta":{"dis":"x"},"rows":[{"a":"n:1 kW"}]}']
    assert column(spark, three, f.json3_decode, f.json4_encode) == column(spark, [grid], f.json4_decode, f.json4_encode)
    with pytest.raises(Exception, match="no Zinc scalar for grid"):
        column(spark, [grid], f.json4_decode, f.zinc_encode)


def test_deep_equality(spark):
    pairs = [
        ("{a:1 b:[2,{c}]}", "{b:[2.0, {c}], a:1}", True),
        ('[@x "one"]', '[@x "two"]', True),
        ("[1,2]", "[2,1]", False),
        ("[1kW]", "[1]", False),
        ("{a}", "{a:M}", True),
        ('["1"]', "[1]", False),
        ("{}", "[]", False),
        ("[[]]", "[[],[]]", False),
        ("[2024-03-01T10:00:00Z UTC]", "[2024-03-01T10:00:00Z]", True),
    ]
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a: string, b: string, same: boolean>")
    df = df.select("i", "p", f.zinc_decode(F.col("p.a")).alias("x"), f.zinc_decode(F.col("p.b")).alias("y"))
    assert [r["e"] for r in df.select("i", kinds.equal(F.col("x"), F.col("y")).alias("e")).orderBy("i").collect()] == [p[2] for p in pairs]


def test_names_twice_in_a_dict_keep_their_order(spark):
    assert column(spark, ["{b:1 a:2 b:3}"], f.zinc_decode, f.zinc_encode) == ["{b:1,a:2,b:3}"]


def test_long_lists(spark):
    long = "[" + ",".join(f'{{n:{i} dis:"item, {i}"}}' for i in range(20_000)) + "]"
    (out,) = column(spark, [long], f.zinc_decode, lambda v: F.size(nested.items(v.json)))
    assert out == 20_000


def test_items_and_entries(spark):
    df = spark.createDataFrame([('[1kW,"a",N,[2]]', "{a:1 b}")], "l string, d string")
    df = df.select(f.zinc_decode(F.col("l")).alias("l"), f.zinc_decode(F.col("d")).alias("d"))
    row = df.select(nested.items(F.col("l.json")).alias("i"), nested.entries(F.col("d.json")).alias("e")).first()
    assert row["i"] == ['{"_kind":"number","unit":"kW","val":1}', '"a"', "null", "[2]"]
    assert row["e"] == {"a": "1", "b": '{"_kind":"marker"}'}


def test_cells_with_brackets_in_files(spark, tmp_path):
    file = tmp_path / "g.zinc"
    file.write_text('ver:"3.0"\nid,l,n\n@a,[[1,[2]],{x:"]," y}],5\n@b,,6\n@c,[],7\n')
    rows = f.read_zinc(spark, str(file))
    out = rows.select("id", F.col("tags")["l"]["json"].alias("l"), F.col("tags")["n"]["num"].alias("n")).orderBy("id").collect()
    assert [tuple(r) for r in out] == [("a", '[[1,[2]],{"x":"],","y":{"_kind":"marker"}}]', 5.0), ("b", None, 6.0), ("c", "[]", 7.0)]
    e = rows.select("id", "tags")
    assert [r["id"] for r in where_dynamic(e, tag("l") == list_of(list_of(1, list_of(2)), dict_of("y", x="],"))).collect()] == ["a"]
    assert [r["id"] for r in where_dynamic(e, tag("l") != list_of()).orderBy("id").collect()] == ["a"]


def test_literals():
    assert list_of(1.0, 2.5, 1e21, True, "é", num(3, "kW"), ref_to("a"))["json"] == '[1,2.5,1000000000000000000000,true,"é",{"_kind":"number","unit":"kW","val":3},{"_kind":"ref","val":"a"}]'
    with pytest.raises(FilterError):
        literal(list_of(float("nan")))
