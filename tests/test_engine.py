import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagframe.functions import filters, kinds, units
from tagframe.functions.filters import MARKER, NULL, fits, num, ref_to, tag
from tagframe.operators import changes, graph, history, ontology, specs
from tagframe.plans import catalog
from tagframe.plans.compile import where_dynamic, where_wide
from tagframe.streaming import changes as stream


def building(spark):
    """A site, two pieces of equipment and six points, with tags of many kinds."""
    m, n, s, r = kinds.marker(), lambda x, u=None: kinds.number(F.lit(x), u), lambda t: kinds.string(F.lit(t)), lambda i: kinds.ref(F.lit(i))
    rows = {
        "site": {"site": m, "dis": s("HQ"), "area": n(5000.0, "ft²"), "geoCity": s("Richmond")},
        "ahu": {"ahu": m, "equip": m, "siteRef": r("site")},
        "vav": {"vav": m, "equip": m, "siteRef": r("site"), "equipRef": r("ahu")},
        "t1": {"point": m, "sensor": m, "temp": m, "equipRef": r("vav"), "curVal": n(72.0, "°F")},
        "t2": {"point": m, "sensor": m, "temp": m, "equipRef": r("vav"), "curVal": n(85.0, "%")},
        "t3": {"point": m, "occ": m, "equipRef": r("ahu"), "curVal": kinds.boolean(F.lit(True)), "writable": m},
        "t4": {"point": m, "equipRef": r("gone"), "curVal": n(float("nan")), "nothing": kinds.value("null")},
        "t5": {"point": m, "curVal": n(-0.0), "at": kinds.date_time(F.lit("2024-03-01 10:00:00").cast("timestamp"), "New_York")},
    }
    out = None
    for ident, tags in rows.items():
        df = spark.range(1).select(F.lit(ident).alias("id"), kinds.tags(id=kinds.ref(F.lit(ident)), **tags).alias("tags"))
        out = df if out is None else out.unionByName(df)
    return out.coalesce(2).cache()


@pytest.fixture(scope="module")
def site(spark):
    return building(spark)


CASES = [
    (tag("site") | tag("equip"), "ahu site vav"),
    (tag("equip") & ~tag("ahu"), "vav"),
    (tag("geoCity") == "Richmond", "site"),
    (tag("siteRef", "geoCity"), "ahu vav"),
    (tag("equipRef", "siteRef", "geoCity") == "Richmond", "t1 t2 t3 vav"),
    (~tag("equipRef", "siteRef"), "ahu site t4 t5"),
    (tag("siteRef") == ref_to("site"), "ahu vav"),
    (tag("curVal") == num(72, "°F"), "t1"),
    (tag("curVal") != num(72, "°F"), "t2 t3 t4 t5"),
    (tag("curVal") != 5, "t1 t2 t3 t4 t5"),
    (tag("curVal") == True, "t3"),
    (tag("curVal") > num(50, "°F"), "t1"),
    (tag("curVal") < num(50, "°F"), ""),
    (tag("curVal") >= 0, "t5"),
    (tag("curVal") == 0, ""),
    (tag("curVal") == float("nan"), "t4"),
    (tag("curVal") > 1, ""),
    (tag("nothing"), "t4"),
    (tag("nothing") == NULL, "t4"),
    (tag("at") == dt.datetime(2024, 3, 1, 10, tzinfo=dt.UTC), ""),
    ((tag("at") <= dt.datetime(2024, 3, 1, 10, tzinfo=dt.UTC)) & (tag("at") >= dt.datetime(2024, 3, 1, 10, tzinfo=dt.UTC)), "t5"),
    ((tag("at") > dt.datetime(2024, 1, 1, tzinfo=dt.UTC)) & tag("point"), "t5"),
    (tag("temp") == MARKER, "t1 t2"),
    (tag("temp") < 5, ""),
    ((tag("site") | tag("ahu")) & (tag("dis") | tag("equip")), "ahu site"),
    (tag("android"), ""),
    (tag("missing", "x"), ""),
]


@pytest.mark.parametrize(("test", "want"), CASES)
def test_filters(site, test, want):
    assert " ".join(sorted(r["id"] for r in where_dynamic(site, test).collect())) == want


def test_types_in_filters(site):
    required = {"ahu": ("ahu", "equip")}
    assert [r["id"] for r in where_dynamic(site, fits("ph::Ahu"), required).collect()] == ["ahu"]
    assert where_dynamic(site, fits("ph::NoSuchType"), required).count() == site.count()
    assert where_dynamic(site, fits("ph::Ahu")).count() == 0
    with pytest.raises(KeyError):
        where_dynamic(site, fits("ph::NoSuchType"), required, strict=True)


@pytest.mark.parametrize("made", [lambda: tag(), lambda: tag("a b"), lambda: tag("a") == [1], lambda: tag("a") & "b", lambda: ~(tag("a") & tag("b")), lambda: tag("a") == tag("b"), lambda: tag("a") and tag("b"), lambda: filters.at(dt.datetime(2024, 1, 1))])
def test_bad_conditions(made):
    with pytest.raises(filters.FilterError):
        made()


def test_conditions_and_literals():
    assert isinstance(tag("a") & tag("b") | tag("c"), filters.Or)
    assert (~tag("a", "b")).path == ("a", "b") and isinstance(~tag("a"), filters.Missing)
    assert (tag("x") == True).literal == {"kind": "bool", "b": True} and (tag("x") > 5).literal["num"] == 5.0  # noqa: E712
    assert (tag("x") == dt.time(1, 2, 3)).literal["t_ns"] == 3_723 * 10**9 and (tag("x") == dt.date(2024, 1, 2)).literal["kind"] == "date"


def test_wide_filters_reach_the_scan(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan(catalog.q08_gt(spark, d))
    assert "LeftOuter" not in plan(catalog.q16_path_three_segments(spark, d)).split("Physical Plan")[-1]
    assert "LeftAnti" in plan(catalog.q19_path_missing(spark, d))
    assert where_wide(catalog.part(spark, d), tag("size") > num(5, "cm")).count() == 0


def test_traversal(spark, site):
    links = graph.edges(site)
    assert {r["src"] for r in graph.refs_to(links, "vav").collect()} == {"t1", "t2"}
    assert {r["id"] for r in graph.equip_points(site, "vav", tag("temp")).collect()} == {"t1", "t2"}
    assert [r["id"] for r in graph.ref_chain(site, "t1", ["equipRef", "siteRef", "siteRef"]).orderBy("step").collect()] == ["vav", "site"]
    assert {r["id"]: r["site_id"] for r in graph.site_for(site).collect()} == {"site": "site", "ahu": "site", "vav": "site", "t1": "site", "t2": "site", "t3": "site", "t4": None, "t5": None}
    assert [(r["src"], r["dst"]) for r in graph.dangling(links, site.select("id")).collect()] == [("t4", "gone")]
    classes = {r["id"]: r["c"] for r in site.select("id", graph.classify(F.col("tags")).alias("c")).collect()}
    assert classes["t1"] == "sensor" and classes["ahu"] == "ahu" and classes["t5"] == "point"
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("c", "a")], "dst string, src string").select("src", F.lit("r").alias("tag"), "dst")
    assert {r["id"]: (r["parent"], r["depth"]) for r in graph.hierarchy(spark, rows, "a").collect()} == {"a": (None, 0), "b": ("a", 1)}


def test_first_of_equal_ids(spark, site):
    rows = site.withColumn("pos", F.lit(1)).unionByName(site.select(F.lit("t1").alias("id"), F.lit(None).cast(kinds.TAGS).alias("tags"), F.lit(0).alias("pos")))
    assert graph.from_rows(rows, "pos").where("id = 't1' and tags is null").count() == 1


def test_units(spark):
    df = spark.createDataFrame([(212.0, "°F", "°C", 100.0), (0.0, "celsius", "fahrenheit", 32.0), (32.0, "°F", "K", 273.15), (1.0, "°C", "m", None), (1.0, "%", "%", None)], "v double, a string, b string, want double")
    for r in df.select("want", units.try_convert(F.col("v"), F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == r["want"] or abs(r["got"] - r["want"]) < 0.01
    with pytest.raises(units.IncompatibleUnits):
        units.convert(F.lit(1.0), "celsius", "meter")
    with pytest.raises(units.UnknownUnit):
        units.convert(F.lit(1.0), "nothing", "meter")


def test_history(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    h = spark.createDataFrame([("p", at(1), 1, 1.0), ("p", at(2), 2, 2.0), ("p", at(2), 3, 3.0), ("q", at(1), 4, 4.0)], "point_id string, ts timestamp, ord long, val double")
    assert [r["val"] for r in history.read(history.last_wins(h), "p", *history.parse_range("2024-01-01,2024-01-02")).collect()] == [1.0, 3.0]
    assert history.read(h, "none").count() == 0
    more = spark.createDataFrame([("p", at(3), 5, 5.0)], h.schema)
    assert sorted(r["val"] for r in history.write(h, more, cap=2).collect()) == [3.0, 4.0, 5.0]
    assert history.parse_range("yesterday", dt.date(2024, 3, 1))[0] == dt.datetime(2024, 2, 29)


def test_ontology(spark, site):
    ns = ontology.Namespace.of([{"symbol": s, "lib": "l", "is": up, "tag_on": on, "of": None, "mandatory": m} for s, up, on, m in [("marker", [], [], False), ("entity", ["marker"], [], False), ("equip", ["entity"], [], True), ("ahu", ["equip"], [], True), ("temp", ["marker"], ["equip"], False), ("sensor", ["vav2"], [], False), ("vav2", ["sensor"], [], False)]])
    assert ns.is_a("ahu", "entity") and ns.supertypes("ahu") == ["equip", "entity", "marker"] and ns.subtypes("equip") == ["ahu"]
    assert ns.mandatory_tags("ahu") == ("ahu", "equip") and ns.mandatory_tags("none") == () and ns.tags_for("ahu") == ["temp"]
    assert ns.kind("equip") == "entity" and ns.without_lib("l").defs == {}
    bad = site.where("id = 'ahu'").select("id", F.map_filter("tags", lambda k, v: k != "equip").alias("tags"))
    assert [(r["issue"], r["tag"]) for r in ontology.validate(bad, ns).orderBy("issue").collect()] == [("dangling_ref", "siteRef"), ("missing_marker", "equip")]
    one = ontology.summary(site, ns).first()
    assert (one["total"], one["with_errors"], one["valid"]) == (8, 0, 2) and one["coverage"] == 0.25
    assert ontology.summary(site.limit(0), ns).first()["coverage"] == 0.0


def test_specs(site):
    s = {"Base": specs.Spec("Base", None, [specs.Slot("point")]), "Temp": specs.Spec("Temp", "Base", [specs.Slot("curVal", "sys::Number", unit="°F", max_val=80), specs.Slot("x", via="equipRef+")])}
    assert [x.name for x in specs.effective_slots(s, "Temp")] == ["point", "curVal", "x"]
    got = {(r["id"], r["issue"], r["slot"]) for r in specs.check(site.where("id in ('site', 'ahu', 'vav', 't1', 't2', 't3')"), s, "Temp").collect()}
    assert got == {("site", "missing_marker", "point"), ("ahu", "missing_marker", "point"), ("vav", "missing_marker", "point"), ("t2", "constraint", "curVal"), ("t3", "wrong_type", "curVal"), ("site", "constraint", "x"), ("ahu", "constraint", "x")}


def test_writes(spark, site):
    new = site.where("id = 't1'").select(F.lit("t9").alias("id"), "tags")
    assert changes.add(site, new).count() == 9
    with pytest.raises(changes.GraphError):
        changes.add(site, site.where("id = 't1'"))
    tags = lambda df, i: df.where(F.col("id") == i).first()["tags"]
    change = site.where("id = 't1'").select("id", F.create_map(F.lit("dis"), kinds.string(F.lit("x")), F.lit("temp"), kinds.value("remove")).alias("tags"))
    after = tags(changes.update(site, change), "t1")
    assert after["dis"]["str"] == "x" and "temp" not in after and "sensor" in after
    with pytest.raises(changes.GraphError):
        changes.update(site, change.select(F.lit("none").alias("id"), "tags"))
    assert changes.remove(site, site.where("id = 't1'")).count() == 7
    write = site.where("id = 't3'").select("id", kinds.number(F.lit(1.0)).alias("val"), F.lit(None).cast("int").alias("level"))
    assert tags(changes.point_write(site, write), "t3")["writeLevel"]["num"] == 17
    with pytest.raises(changes.GraphError):
        changes.point_write(site, write.select(F.lit("t1").alias("id"), "val", "level"))


def log_of(spark):
    value = F.create_map(F.lit("v"), kinds.number(F.col("n").cast("double")))
    df = spark.createDataFrame([(1, "add", "a", 1), (2, "add", "b", 2), (3, "update", "a", 3), (4, "remove", "b", 4), (5, "add", "b", 5)], "version long, op string, ref string, n int")
    empty = F.lit(None).cast(kinds.TAGS)
    return df.select("version", "op", "ref", empty.alias("old"), F.when(F.col("op") == "add", value).alias("new"), F.when(F.col("op") == "update", value).alias("changed"), empty.alias("previous"))


def test_watches_without_limits(spark):
    ids = lambda first, n: spark.range(first, first + n).select(F.col("id").cast("string").alias("id"))
    none = spark.createDataFrame([], "watch_id string, owner string, id string, last_version long")
    many = changes.IDS_A_USER + 1
    with pytest.raises(changes.GraphError, match="too many"):
        changes.subscribe(none, "w", "me", ids(0, many), 3)
    w = changes.subscribe(none, "w", "me", ids(0, many), 3, limited=False)
    with pytest.raises(changes.GraphError, match="too many"):
        changes.watch_ids(w, "w", "me", ids(many, 1))
    w = changes.watch_ids(w, "w", "me", ids(many - 10, many), limited=False)
    assert w.count() == w.select("id").distinct().count() == 2 * many - 10
    with pytest.raises(changes.GraphError, match="no such watch"):
        changes.watch_ids(w, "x", "me", ids(0, 1), limited=False)


def test_change_log_and_watches(spark):
    log = log_of(spark).cache()
    assert [r["version"] for r in changes.since(log, 3).collect()] == [4, 5]
    with pytest.raises(changes.ChangelogGap):
        changes.since(log, 1, floor=2)
    kept, floor = changes.retained(log, 2)
    assert kept.count() == 2 and floor == 3
    now = changes.replay(log)
    assert {r["id"]: r["tags"]["v"]["num"] for r in now.collect()} == {"a": 3.0, "b": 5.0}
    watches = spark.createDataFrame([], "watch_id string, owner string, id string, last_version long")
    watches = changes.subscribe(watches, "w", "me", now.select("id"), 3)
    assert [r["id"] for r in changes.poll(watches, "w", "me", log, now).collect()] == ["b"]
    assert changes.poll(watches, "w", "me", log, now, floor=4).count() == 2
    with pytest.raises(changes.GraphError):
        changes.poll(watches, "w", "you", log, now)
    rows, more = changes.poll_rows(log, 0, rows=2)
    assert rows.count() == 2 and more


def test_streams_agree_with_batches(spark, tmp_path):
    log = log_of(spark)
    log.repartition(2).write.parquet(str(tmp_path / "log"))
    watches = spark.createDataFrame([("w", "a"), ("w", "b"), ("x", "a")], "watch_id string, id string")
    seen = {}
    q = stream.notify(stream.changes(spark, str(tmp_path / "log"), after=3), watches, lambda n, df: seen.update({r["watch_id"]: r["ids"] for r in df.collect()}), str(tmp_path / "c1"), {"availableNow": True})
    q.awaitTermination()
    assert seen == {"w": ["b"]}
    h = spark.createDataFrame([("p", dt.datetime(2024, 1, 1), 1, 1.0), ("p", dt.datetime(2024, 1, 1), 2, 2.0)], "point_id string, ts timestamp, ord long, val double")
    h.write.parquet(str(tmp_path / "his"))
    stream.keep_history(spark.readStream.schema(h.schema).parquet(str(tmp_path / "his")), str(tmp_path / "kept"), str(tmp_path / "c2")).awaitTermination()
    assert [r["val"] for r in history.last_wins(spark.read.parquet(str(tmp_path / "kept")).drop("batch")).collect()] == [2.0]
