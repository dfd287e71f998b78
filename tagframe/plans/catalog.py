"""The engine's queries over the star-schema tables seen as tagged entities, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.functions import kinds, units
from tagframe.functions.filters import fits, num, ref_to, tag
from tagframe.operators import changes, graph, history, ontology, specs
from tagframe.plans.compile import Branch, Branches, Tag, Wide, where_dynamic, where_wide
from tagframe.sources import formats

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- entity views ----------------------------------------------------------------------------------


def region(spark, d) -> Wide:
    return Wide(table(spark, d, "region"), {"dis": Tag("r_name")}, ("region",))


def nation(spark, d) -> Wide:
    return Wide(table(spark, d, "nation"), {"dis": Tag("n_name"), "regionRef": Tag("n_regionkey", "ref", target=region(spark, d), target_key="r_regionkey")}, ("nation",))


def customer(spark, d) -> Wide:
    tags = {"dis": Tag("c_name"), "acctbal": Tag("c_acctbal", "number"), "mktsegment": Tag("c_mktsegment"), "nationRef": Tag("c_nationkey", "ref", target=nation(spark, d), target_key="n_nationkey")}
    return Wide(table(spark, d, "customer"), tags, ("customer",))


def part(spark, d) -> Wide:
    return Wide(table(spark, d, "part"), {"dis": Tag("p_name"), "brand": Tag("p_brand"), "type": Tag("p_type"), "size": Tag("p_size", "number", "in"), "retailprice": Tag("p_retailprice", "number")}, ("part",))


def orders(spark, d) -> Wide:
    tags = {"custRef": Tag("o_custkey", "ref", target=customer(spark, d), target_key="c_custkey"), "status": Tag("o_orderstatus"), "totalprice": Tag("o_totalprice", "number"), "orderDate": Tag("o_orderdate", "dateTime"), "priority": Tag("o_orderpriority")}
    return Wide(table(spark, d, "orders"), tags, ("order",))


def lineitem(spark, d) -> Wide:
    tags = {"orderRef": Tag("l_orderkey", "ref", target=orders(spark, d), target_key="o_orderkey"), "partRef": Tag("l_partkey", "ref", target=part(spark, d), target_key="p_partkey"), "quantity": Tag("l_quantity", "number"), "discount": Tag("l_discount", "number"), "returnflag": Tag("l_returnflag")}
    return Wide(table(spark, d, "lineitem"), tags, ("lineitem",))


def documents(spark, d) -> Wide:
    labels = Wide(table(spark, d, "labels"), {"quality": Tag("quality", "number"), "toxic": Tag("toxic", "number")}, ("label",))
    return Wide(table(spark, d, "documents").drop("text"), {"lang": Tag("lang"), "source": Tag("source"), "nChars": Tag("n_chars", "number"), "labelRef": Tag("doc_id", "ref", target=labels, target_key="doc_id")}, ("document",))


def labelled(spark, d) -> Wide:
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return Wide(df, {"lang": Tag("lang"), "quality": Tag("quality", "number"), "toxic": Tag("toxic", "number")}, ("document",))


def branches(spark, d) -> Branches:
    """Regions, nations, customers and suppliers as entities."""
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    of = lambda name, prefix, key, **tags: Branch(table(spark, d, name), ident(prefix, key), {name: kinds.marker()} | tags)
    return Branches(
        [
            of("region", "region-", "r_regionkey", site=kinds.marker(), dis=kinds.string(F.col("r_name"))),
            of("nation", "nation-", "n_nationkey", dis=kinds.string(F.col("n_name")), siteRef=kinds.ref(ident("region-", "n_regionkey"))),
            of("customer", "cust-", "c_custkey", dis=kinds.string(F.col("c_name")), acctbal=kinds.number(F.col("c_acctbal"), "USD"), segment=kinds.string(F.col("c_mktsegment")), equipRef=kinds.ref(ident("nation-", "c_nationkey"))),
            of("supplier", "supp-", "s_suppkey", dis=kinds.string(F.col("s_name")), acctbal=kinds.number(F.col("s_acctbal"), "EUR"), equipRef=kinds.ref(ident("nation-", "s_nationkey"))),
        ]
    )


def star(spark, d) -> DataFrame:
    """The same with tag maps."""
    return branches(spark, d).frame()


def star_edges(spark, d) -> DataFrame:
    """The same references from the columns, without building maps."""
    e = lambda t, src, sp, tag, dst, dp: table(spark, d, t).select(F.concat(F.lit(sp), F.col(src).cast("string")).alias("src"), F.lit(tag).alias("tag"), F.concat(F.lit(dp), F.col(dst).cast("string")).alias("dst"))
    return e("nation", "n_nationkey", "nation-", "regionRef", "n_regionkey", "region-").unionByName(e("customer", "c_custkey", "cust-", "nationRef", "c_nationkey", "nation-")).unionByName(e("supplier", "s_suppkey", "supp-", "nationRef", "s_nationkey", "nation-"))


_EDGES = """SELECT 'nation-' || n_nationkey AS src, 'regionRef' AS tag, 'region-' || n_regionkey AS dst FROM nation
UNION ALL SELECT 'cust-' || c_custkey, 'nationRef', 'nation-' || c_nationkey FROM customer
UNION ALL SELECT 'supp-' || s_suppkey, 'nationRef', 'nation-' || s_nationkey FROM supplier"""


def points(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("point_id"), "ts", F.col("event_id").alias("ord"), F.col("value").alias("val"))


# --- predicates ------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def q01_has(spark, d):
    return where_wide(labelled(spark, d), tag("document") & tag("quality")).select("doc_id", "lang", "quality")


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def q02_missing(spark, d):
    return where_wide(labelled(spark, d), ~tag("quality")).select("doc_id", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def q03_eq_str(spark, d):
    return where_wide(customer(spark, d), tag("mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def q04_ne_str(spark, d):
    return where_wide(customer(spark, d), tag("mktsegment") != "BUILDING").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality <> 1")
def q05_ne_missing_is_false(spark, d):
    return where_wide(labelled(spark, d), tag("quality") != 1).select("doc_id", "quality")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def q06_lt(spark, d):
    return where_wide(part(spark, d), tag("size") < num(10, "in")).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1000")
def q07_le(spark, d):
    return where_wide(part(spark, d), tag("retailprice") <= 1000).select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def q08_gt(spark, d):
    return where_wide(orders(spark, d), tag("totalprice") > 100000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size >= 40 AND NOT p_size < 0")
def q09_ge_unit_mismatch_is_false(spark, d):
    return where_wide(part(spark, d), (tag("size") >= num(40, "in")) | (tag("size") >= num(1, "cm"))).select("p_partkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def q10_datetime_range(spark, d):
    w = orders(spark, d)
    w = Wide(w.df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), w.tags, w.markers)
    return where_wide(w, (tag("orderDate") >= dt.datetime(1995, 1, 1, tzinfo=dt.UTC)) & (tag("orderDate") < dt.datetime(1996, 1, 1, tzinfo=dt.UTC))).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '2'")
def q11_string_order(spark, d):
    return where_wide(orders(spark, d), tag("priority") < "2").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000 AND c_mktsegment = 'MACHINERY'")
def q12_precedence(spark, d):
    return where_wide(customer(spark, d), (tag("mktsegment") == "BUILDING") | ((tag("acctbal") > 5000) & (tag("mktsegment") == "MACHINERY"))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 5000) AND (c_acctbal < 9000 AND (c_acctbal > 0))")
def q13_nested(spark, d):
    return where_wide(customer(spark, d), ((tag("mktsegment") == "BUILDING") | (tag("acctbal") > 5000)) & ((tag("acctbal") < 9000) & (tag("acctbal") > 0))).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50")
def q14_read_limit(spark, d):
    return where_wide(orders(spark, d), tag("totalprice") > 1000).orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


# --- paths -----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def q15_path_two_segments(spark, d):
    return where_wide(customer(spark, d), tag("nationRef", "dis") == "NATION_3").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 AND r_name = 'ASIA'")
def q16_path_three_segments(spark, d):
    return where_wide(customer(spark, d), (tag("customer") & (tag("acctbal") > 5000)) & (tag("nationRef", "regionRef", "dis") == "ASIA")).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND l_quantity > 25")
def q17_path_four_segments(spark, d):
    return where_wide(lineitem(spark, d), (tag("orderRef", "custRef", "nationRef", "dis") == "NATION_7") & (tag("quantity") > 25)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def q18_path_exists(spark, d):
    return where_wide(documents(spark, d), tag("labelRef", "quality")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def q19_path_missing(spark, d):
    return where_wide(documents(spark, d), ~tag("labelRef", "quality")).select("doc_id", "lang")


# --- references ------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({_EDGES}) WHERE src = 'nation-5'")
def q20_refs_from(spark, d):
    return graph.refs_from(star_edges(spark, d), "nation-5")


@query(f"SELECT * FROM ({_EDGES}) WHERE dst = 'nation-5' AND tag = 'nationRef'")
def q21_refs_to(spark, d):
    return graph.refs_to(star_edges(spark, d), "nation-5", "nationRef")


@query("SELECT 'nation-' || n_nationkey AS id, n_name AS dis FROM nation WHERE n_regionkey = 2")
def q22_children(spark, d):
    return graph.children(star(spark, d), "region-2").select("id", F.col("tags")["dis"].str.alias("dis"))


@query("SELECT 1 AS step, 'nation-' || c_nationkey AS id FROM customer WHERE c_custkey = 7 UNION ALL SELECT 2, 'region-' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def q23_ref_chain(spark, d):
    return graph.ref_chain(star(spark, d), "cust-7", ["equipRef", "siteRef"]).select("step", "id")


@query("""SELECT 'cust-' || c_custkey AS id, 'region-' || n_regionkey AS site_id FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supp-' || s_suppkey, 'region-' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation UNION ALL SELECT 'region-' || r_regionkey, 'region-' || r_regionkey FROM region""")
def q24_site_for(spark, d):
    return graph.site_for(branches(spark, d))


@query("SELECT pos, id, c_name AS dis FROM (VALUES (0, 'cust-3'), (1, 'cust-none'), (2, 'cust-1'), (3, 'cust-3')) t(pos, id) LEFT JOIN customer ON id = 'cust-' || c_custkey")
def q25_read_ids(spark, d):
    ids = spark.createDataFrame([(0, "cust-3"), (1, "cust-none"), (2, "cust-1"), (3, "cust-3")], "pos int, id string")
    return graph.read_ids(ids, star(spark, d)).select("pos", "id", F.col("tags")["dis"].str.alias("dis"))


@query("SELECT 'region-' || r_regionkey AS id, r_name AS dis, 'region-' || r_regionkey AS nav_id FROM region")
def q26_nav(spark, d):
    return graph.nav(star(spark, d))


# --- types and checks ------------------------------------------------------------------------------

_NAMESPACE = ontology.Namespace.of(
    [
        {"symbol": s, "lib": "lib:own", "is": up, "tag_on": on, "of": None, "mandatory": m}
        for s, up, on, m in [("entity", [], [], False), ("party", ["entity"], [], False), ("customer", ["party"], [], True), ("supplier", ["party"], [], True), ("segment", [], ["customer"], False), ("nation", ["entity"], [], True), ("site", ["entity"], [], True), ("region", ["site"], [], True), ("acctbal", [], ["party"], False)]
    ]
)


@query("SELECT 'region-' || r_regionkey AS id FROM region")
def q27_fits(spark, d):
    return where_dynamic(branches(spark, d), fits("own::Region"), _NAMESPACE.required()).select("id")


@query("SELECT 'nation-' || n_nationkey AS id, unnest(['region', 'site']) AS missing FROM nation")
def q28_fits_explain(spark, d):
    e = where_dynamic(branches(spark, d), tag("nation"))
    return e.select("id", F.explode(ontology.missing(F.col("tags"), _NAMESPACE.mandatory_tags("region"))).alias("missing"))


def _labelled_docs(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    both = docs.join(labels, "doc_id", "left")
    return both.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), kinds.tags(document=kinds.marker(), judged=F.when(F.col("quality").isNotNull(), kinds.marker()), toxic=F.when(F.col("toxic") == 1, kinds.marker()), labelRef=kinds.ref(F.concat(F.lit("label-"), F.col("doc_id").cast("string")))).alias("tags"))


_DOC_TYPES = ontology.Namespace.of([{"symbol": s, "lib": "lib:own", "is": up, "tag_on": [], "of": None, "mandatory": m} for s, up, m in [("entity", [], False), ("judged", ["entity"], True), ("toxic", ["judged"], True), ("document", ["toxic"], False)]])


@query("""SELECT 'doc-' || doc_id AS id, t.tag AS tag, 'document' AS detail FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('judged'), ('toxic')) t(tag) WHERE (t.tag = 'judged' AND quality IS NULL) OR (t.tag = 'toxic' AND coalesce(toxic, 0) <> 1)
UNION ALL SELECT 'doc-' || doc_id, 'toxic', 'judged' FROM documents JOIN labels USING (doc_id) WHERE false""")
def q29_validate(spark, d):
    return ontology.validate(_labelled_docs(spark, d), _DOC_TYPES).where("issue = 'missing_marker'").select("id", "tag", "detail")


@query("SELECT 'doc-' || doc_id AS src, 'labelRef' AS tag, 'label-' || doc_id AS dst FROM documents ANTI JOIN labels USING (doc_id)")
def q30_dangling(spark, d):
    labels = table(spark, d, "labels").select(F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("id"))
    links = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("src"), F.lit("labelRef").alias("tag"), F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("dst"))
    return graph.dangling(links, labels)


@query("""SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL AND toxic = 1) AS valid, count(*) FILTER (NOT (quality IS NOT NULL AND coalesce(toxic, 0) = 1)) AS with_errors,
CAST(0 AS BIGINT) AS untyped, CAST(0 AS BIGINT) AS with_warnings, CAST(1.0 AS DOUBLE) AS coverage FROM documents LEFT JOIN labels USING (doc_id)""")
def q31_validation_summary(spark, d):
    return ontology.summary(_labelled_docs(spark, d), _DOC_TYPES)


@query("SELECT lang, count(*) AS total, count(quality) AS typed, count(quality) / count(*) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def q32_coverage(spark, d):
    n, t = F.count(F.lit(1)), F.count("quality")
    return labelled(spark, d).df.groupBy("lang").agg(n.alias("total"), t.alias("typed"), F.try_divide(t, n).alias("coverage"))


@query("""SELECT tag, sum(n)::BIGINT AS n FROM (SELECT unnest(['region','site','dis']) AS tag, 1 AS n FROM region UNION ALL SELECT unnest(['nation','dis','siteRef']), 1 FROM nation
UNION ALL SELECT unnest(['customer','dis','acctbal','segment','equipRef']), 1 FROM customer UNION ALL SELECT unnest(['supplier','dis','acctbal','equipRef']), 1 FROM supplier) GROUP BY tag ORDER BY n DESC, tag LIMIT 15""")
def q33_tag_distribution(spark, d):
    return star(spark, d).select(F.explode(F.map_keys("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(15)


@query("SELECT unnest(['acctbal','customer','dis','equipRef','nation','region','segment','site','siteRef','supplier']) AS tag")
def q34_column_union(spark, d):
    return graph.columns_of(star(spark, d))


# --- history ---------------------------------------------------------------------------------------


@query("SELECT user_id AS point_id, ts, value AS val FROM events WHERE user_id = 7 AND ts >= (SELECT date_trunc('day', min(ts)) FROM events) AND ts <= (SELECT date_trunc('day', min(ts)) + INTERVAL 20 DAY FROM events)")
def q35_history_range(spark, d):
    first = table(spark, d, "events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("first")).scalar()
    return history.read(points(spark, d), 7, first, first + F.expr("INTERVAL 20 DAYS")).select("point_id", "ts", "val")


@query("SELECT user_id AS point_id, date_trunc('day', ts) AS ts, max(event_id) AS ord, arg_max(value, event_id) AS val FROM events GROUP BY 1, 2")
def q36_last_wins(spark, d):
    return history.last_wins(points(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")))


@query("SELECT point_id, ts, ord, val FROM (SELECT user_id AS point_id, ts, event_id AS ord, value AS val, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def q37_history_cap(spark, d):
    return history.capped(points(spark, d), 3)


@query("SELECT user_id AS point_id, count(*) AS n FROM events GROUP BY 1")
def q38_history_count(spark, d):
    return history.counts(points(spark, d))


@query("""SELECT 'region-1' AS id, NULL::VARCHAR AS parent, 0 AS depth UNION ALL SELECT 'nation-' || n_nationkey, 'region-1', 1 FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'cust-' || c_custkey, 'nation-' || c_nationkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'supp-' || s_suppkey, 'nation-' || s_nationkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def q39_hierarchy(spark, d):
    return graph.hierarchy(spark, star_edges(spark, d), "region-1")


# --- functions -------------------------------------------------------------------------------------


@query("SELECT p_partkey, round((p_size * 0.0254 + 0.0 - 0.0) / 0.01, 6) AS size_cm FROM part")
def q41_unit_convert(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(units.convert(F.col("p_size"), "in", "cm"), 6).alias("size_cm"))


@query("SELECT p_partkey, p_size % 3 = 0 AS ok, CASE WHEN p_size % 3 = 0 THEN 'length' WHEN p_size % 3 = 1 THEN 'temperature' END AS quantity FROM part")
def q42_compatible(spark, d):
    unit = F.when(F.col("p_size") % 3 == 0, "ft").when(F.col("p_size") % 3 == 1, "°F").otherwise("no-unit")
    return table(spark, d, "part").select("p_partkey", units.compatible(unit, F.lit("m")).alias("ok"), units.quantity(unit).alias("quantity"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'sensor' WHEN p_size > 20 THEN 'ahu' WHEN p_size > 10 THEN 'site' END AS class FROM part")
def q43_classify(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", graph.classify({"site": size > 10, "ahu": size > 20, "sensor": size > 40}).alias("class"))


# --- changes ---------------------------------------------------------------------------------------


def change_log(spark, d) -> DataFrame:
    """Events as changes: the first of a user adds, every 50th event removes, others update."""
    e = table(spark, d, "events").withColumn("_first", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1)
    tags = F.create_map(F.lit("value"), kinds.number(F.col("value")), F.lit("type"), kinds.string(F.col("event_type")))
    op = F.when(F.col("_first"), "add").when(F.col("event_id") % 50 == 0, "remove").otherwise("update")
    e = e.select((F.col("event_id") + 1).alias("version"), op.alias("op"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("ref"), tags.alias("tags"))
    return e.select("version", "op", "ref", F.when(F.col("op") == "add", F.col("tags")).alias("new"), F.when(F.col("op") == "update", F.col("tags")).alias("changed"))


_LOG = "SELECT event_id + 1 AS version, 'user-' || user_id AS ref, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'add' WHEN event_id % 50 = 0 THEN 'remove' ELSE 'update' END AS op, value, event_type FROM events"


@query(f"SELECT version, op, ref FROM ({_LOG}) WHERE version > 500")
def q44_changes_since(spark, d):
    return changes.since(change_log(spark, d), 500, floor=100).select("version", "op", "ref")


@query(f"SELECT DISTINCT ref AS id FROM ({_LOG}) WHERE version > 500 AND ref IN ('user-1', 'user-2', 'user-3', 'user-none')")
def q45_watch_poll(spark, d):
    log = change_log(spark, d)
    watches = spark.createDataFrame([("w1", "me", i, 500) for i in ("user-1", "user-2", "user-3", "user-none")], "watch_id string, owner string, id string, last_version long")
    now = log.select(F.col("ref").alias("id")).distinct()
    return changes.poll(watches, "w1", "me", log, now)


@query(f"""WITH log AS ({_LOG}), last AS (SELECT ref, max(version) FILTER (op IN ('add', 'remove')) AS v, arg_max(op, version) FILTER (op IN ('add', 'remove')) AS o FROM log GROUP BY ref)
SELECT ref AS id, arg_max(value, version) AS value, arg_max(event_type, version) AS type FROM log JOIN last USING (ref) WHERE version >= v AND o <> 'remove' GROUP BY ref""")
def q46_replay(spark, d):
    return changes.replay(change_log(spark, d)).select("id", F.col("tags")["value"].num.alias("value"), F.col("tags")["type"].str.alias("type"))


@query("""SELECT 'M,"' || n_name || '",@region-' || n_regionkey AS value FROM nation""")
def q47_zinc_rows(spark, d):
    return formats.zinc_lines(where_dynamic(branches(spark, d), tag("nation")), ["nation", "dis", "siteRef"])


@query("SELECT o_orderkey, o_totalprice AS num, 'USD' AS unit FROM orders")
def q48_json4_decode(spark, d):
    raw = F.to_json(F.struct(F.lit("number").alias("_kind"), F.col("o_totalprice").alias("val"), F.lit("USD").alias("unit")))
    v = formats.json4_decode(raw)
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.num", "v.unit")


@query("SELECT doc_id, 'n:' || n_chars || ' ch' AS raw, n_chars::DOUBLE AS num, 'ch' AS unit FROM documents")
def q49_json3_number(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.concat(F.lit("n:"), F.col("n_chars").cast("string"), F.lit(" ch")).alias("raw"))
    return df.select("doc_id", "raw", formats.json3_decode(F.concat(F.lit('"'), F.col("raw"), F.lit('"'))).alias("v")).select("doc_id", "raw", "v.num", "v.unit")


@query("SELECT 'cust-' || c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 9000")
def q50_dynamic_unit(spark, d):
    """Suppliers have another unit, so no order with this one."""
    return where_dynamic(branches(spark, d), tag("acctbal") > num(9000, "USD")).select("id", F.col("tags")["acctbal"].num.alias("acctbal"))


@query("""SELECT 'cust-' || c_custkey AS id FROM customer WHERE c_acctbal <> 0 UNION ALL SELECT 'supp-' || s_suppkey FROM supplier""")
def q51_dynamic_ne_unit(spark, d):
    """Values differ by the sign of zero too, so both zeros are left out."""
    return where_dynamic(branches(spark, d), (tag("acctbal") != num(0, "USD")) & (tag("acctbal") != num(-0.0, "USD"))).select("id")


@query("SELECT 'cust-' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_mktsegment = 'BUILDING'")
def q52_dynamic_path(spark, d):
    return where_dynamic(branches(spark, d), (tag("segment") == "BUILDING") & (tag("equipRef", "siteRef", "dis") == "EUROPE")).select("id")


@query("SELECT 'nation-' || n_nationkey AS id FROM nation WHERE n_regionkey = 2")
def q53_ref_eq(spark, d):
    return where_dynamic(branches(spark, d), tag("siteRef") == ref_to("region-2")).select("id")


@query("""SELECT 'cust-' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'VIP' ELSE c_name END AS dis, c_custkey % 3 <> 0 AS has_segment FROM customer""")
def q54_merge_remove(spark, d):
    e = where_dynamic(branches(spark, d), tag("customer"))
    key = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    new = F.map_concat(F.when(key % 2 == 0, F.create_map(F.lit("dis"), kinds.string(F.lit("VIP")))).otherwise(F.expr("map()").cast(kinds.TAGS)), F.when(key % 3 == 0, F.create_map(F.lit("segment"), kinds.value("remove"))).otherwise(F.expr("map()").cast(kinds.TAGS)))
    out = changes.upsert(e, e.select("id", new.alias("tags")))
    return out.select("id", F.col("tags")["dis"].str.alias("dis"), F.map_contains_key("tags", "segment").alias("has_segment"))


@query("SELECT 'nation-' || n_nationkey AS id FROM nation UNION ALL SELECT 'region-' || r_regionkey FROM region UNION ALL SELECT 'supp-' || s_suppkey FROM supplier")
def q55_remove(spark, d):
    e = star(spark, d)
    return changes.remove(e, where_dynamic(e, tag("customer")).select("id")).select("id")


@query("SELECT 'w-' || (user_id % 5) AS watch_id, list_sort(list(DISTINCT 'user-' || user_id)) AS ids FROM events WHERE event_id + 1 > 500 GROUP BY 1")
def q56_affected(spark, d):
    log = changes.since(change_log(spark, d), 500)
    watches = log.sparkSession.read.parquet(f"{d}/events.parquet").select("user_id").distinct().select(F.concat(F.lit("w-"), (F.col("user_id") % 5).cast("string")).alias("watch_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"))
    return changes.affected(watches, log)


@query("SELECT 'cust-' || c_custkey AS id, 'Str' AS dis_type, 'Number' AS acctbal_type, 'Ref' AS ref_type FROM customer")
def q58_type_names(spark, d):
    e = where_dynamic(branches(spark, d), tag("customer"))
    return e.select("id", *[kinds.type_name(F.col("tags")[t].kind).alias(n) for t, n in (("dis", "dis_type"), ("acctbal", "acctbal_type"), ("equipRef", "ref_type"))])


# --- grids that keep kinds -------------------------------------------------------------------------


def _grid(spark, d, cells: Column) -> DataFrame:
    text = F.concat(F.lit('{"meta":{"ver":"3.0"},"cols":[],"rows":['), F.to_json(cells), F.lit("]}"))
    return table(spark, d, "nation").select(F.col("n_name").alias("file"), text.alias("text"))


_GRID_CELLS = """SELECT 'n-' || n_nationkey AS id, n_nationkey::VARCHAR AS a, 'str' AS a_kind, 'true' AS b, 'str' AS b_kind, '[' || n_name || ']' AS c, 'str' AS c_kind, n_nationkey + 0.5::DOUBLE AS n, 'list' AS l_kind FROM nation"""


def _grid_cells(rows: DataFrame) -> DataFrame:
    t = lambda name: F.col("tags")[name]
    return rows.select("id", *[x for k in "abc" for x in (t(k).str.alias(k), t(k).kind.alias(f"{k}_kind"))], t("n").num.alias("n"), t("l").kind.alias("l_kind"))


@query(_GRID_CELLS)
def q59_json4_grid(spark, d):
    key = F.col("n_nationkey")
    ident = F.struct(F.lit("ref").alias("_kind"), F.concat(F.lit("n-"), key.cast("string")).alias("val"))
    cells = F.struct(ident.alias("id"), key.cast("string").alias("a"), F.lit("true").alias("b"), F.concat(F.lit("["), "n_name", F.lit("]")).alias("c"), (key + 0.5).cast("double").alias("n"), F.array(F.lit(1), F.lit(2)).alias("l"))
    return _grid_cells(formats.json_rows(_grid(spark, d, cells), formats.json4_decode))


@query(_GRID_CELLS)
def q60_json3_grid(spark, d):
    key = F.col("n_nationkey").cast("string")
    cells = F.struct(F.concat(F.lit("r:n-"), key).alias("id"), key.alias("a"), F.lit("s:true").alias("b"), F.concat(F.lit("["), "n_name", F.lit("]")).alias("c"), F.concat(F.lit("n:"), key, F.lit(".5 kW")).alias("n"), F.array(F.lit("n:1")).alias("l"))
    return _grid_cells(formats.json_rows(_grid(spark, d, cells), formats.json3_decode))


# --- more walks ------------------------------------------------------------------------------------


def _with_tag(entities: DataFrame, name: str, test: Column, val: Column | None = None) -> DataFrame:
    more = F.when(test, F.create_map(F.lit(name), kinds.marker() if val is None else val)).otherwise(F.expr("map()").cast(kinds.TAGS))
    return entities.select("id", F.map_concat("tags", more).alias("tags"))


@query("SELECT 'cust-' || c_custkey AS id FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def q61_equip_points(spark, d):
    e = _with_tag(star(spark, d), "point", F.coalesce(F.col("tags")["segment"].str == "BUILDING", F.lit(False)))
    return graph.equip_points(e, "nation-3", tag("acctbal") > num(0, "USD")).select("id")


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS k, p_partkey // 2 AS t FROM part WHERE p_partkey > 1 UNION ALL SELECT k, t // 2 FROM up WHERE t > 1)
SELECT 'part-' || k AS id, 'part-' || t AS target FROM up""")
def q62_reached(spark, d):
    """A tree of parts: every part refers to that of half its number."""
    key = F.col("p_partkey")
    ident = lambda k: F.concat(F.lit("part-"), k.cast("string"))
    e = table(spark, d, "part").select(ident(key).alias("id"), kinds.tags(part=kinds.marker(), upRef=F.when(key > 1, kinds.ref(ident(F.floor(key / 2))))).alias("tags"))
    return specs.reached(e, "upRef+")


_SPECS = {
    s.name: s
    for s in (
        specs.Spec("Party", None, [specs.Slot("dis", "Str", non_empty=True, pattern="^[A-Z]"), specs.Slot("acctbal", "Number", min_val=0.0, max_val=9000.0, unit="USD")]),
        specs.Spec("Buyer", "Party", [specs.Slot("customer"), specs.Slot("segment", "Str", max_size=8), specs.Slot("vip", maybe=True)]),
        specs.Spec("Placed", None, [specs.Slot("region", via="siteRef"), specs.Slot("top", via="upRef+", maybe=True)]),
    )
}


@query("""SELECT 'cust-' || c_custkey AS id, 'constraint' AS issue, 'acctbal' AS slot FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000
UNION ALL SELECT 'cust-' || c_custkey, 'constraint', 'segment' FROM customer WHERE length(c_mktsegment) > 8
UNION ALL SELECT 'supp-' || s_suppkey, 'missing_marker', 'customer' FROM supplier UNION ALL SELECT 'supp-' || s_suppkey, 'constraint', 'acctbal' FROM supplier""")
def q63_spec_check(spark, d):
    """Suppliers have another unit and are no customers."""
    e = star(spark, d).where(F.map_contains_key("tags", F.lit("acctbal")))
    return specs.check(e, _SPECS, "Buyer")


@query("SELECT 'region-' || r_regionkey AS id, 'constraint' AS issue, 'region' AS slot FROM region UNION ALL SELECT 'cust-' || c_custkey, 'constraint', 'region' FROM customer UNION ALL SELECT 'supp-' || s_suppkey, 'constraint', 'region' FROM supplier")
def q64_query_slot(spark, d):
    return specs.check(star(spark, d), _SPECS, "Placed")


# --- more writes and watches -----------------------------------------------------------------------


@query("SELECT 'cust-' || c_custkey AS id FROM customer UNION ALL SELECT 'supp-' || s_suppkey FROM supplier")
def q66_add(spark, d):
    e = star(spark, d)
    return changes.add(where_dynamic(e, tag("customer")), where_dynamic(e, tag("supplier"))).select("id")


@query("SELECT 'supp-' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * 2 END AS cur_val, CASE WHEN s_suppkey % 8 = 0 THEN 8.0::DOUBLE WHEN s_suppkey % 4 = 0 THEN 17.0::DOUBLE END AS level FROM supplier")
def q67_point_write(spark, d):
    e = _with_tag(where_dynamic(branches(spark, d), tag("supplier")), "writable", F.lit(True))
    key = F.col("s_suppkey")
    writes = table(spark, d, "supplier").where(key % 4 == 0).select(F.concat(F.lit("supp-"), key.cast("string")).alias("id"), kinds.number(F.col("s_acctbal") * 2).alias("val"), F.when(key % 8 == 0, 8).alias("level"))
    return changes.point_write(e, writes).select("id", F.col("tags")["curVal"].num.alias("cur_val"), F.col("tags")["writeLevel"].num.alias("level"))


@query("""WITH h AS (SELECT user_id AS point_id, date_trunc('day', ts) AS ts, event_id AS ord, value AS val FROM events UNION ALL SELECT user_id, date_trunc('day', ts), event_id + 1000000000, -value FROM events WHERE event_type = 'click'),
l AS (SELECT point_id, ts, max(ord) AS ord, arg_max(val, ord) AS val FROM h GROUP BY 1, 2)
SELECT point_id, ts, ord, val FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts DESC) AS n FROM l) WHERE n <= 5""")
def q68_history_write(spark, d):
    h = points(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    e = table(spark, d, "events").where("event_type = 'click'")
    rows = e.select(F.col("user_id").alias("point_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), (F.col("event_id") + 1_000_000_000).alias("ord"), (-F.col("value")).alias("val"))
    return history.write_all(h, rows, cap=5)


@query("SELECT user_id AS point_id, ts, value AS val FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-19 23:59:59'")
def q69_history_named_range(spark, d):
    start, end = history.parse_range("2024-01-03,2024-01-19")
    return history.read(points(spark, d), 5, start, end).select("point_id", "ts", "val")


@query(f"SELECT version, op, ref FROM ({_LOG}) WHERE version > (SELECT max(event_id) + 1 - 300 FROM events)")
def q70_retained(spark, d):
    return changes.retained(change_log(spark, d), 300)[0].select("version", "op", "ref")


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def q72_watched_total(spark, d):
    e = table(spark, d, "events")
    watches = e.select(F.concat(F.lit("w-"), (F.col("event_id") % 3).cast("string")).alias("watch_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"))
    return changes.watched(watches).agg(F.count(F.lit(1)).alias("n"))


# --- more functions --------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN round(p_size * 0.0254 / 0.3048, 6) END AS feet, CASE WHEN p_size % 2 = 0 THEN 'foot' END AS unit FROM part")
def q73_convert_number(spark, d):
    v = kinds.number(F.col("p_size").cast("double"), F.when(F.col("p_size") % 2 == 0, "in").otherwise("kg"))
    out = table(spark, d, "part").select("p_partkey", units.convert_number(v, "ft").alias("v"))
    return out.select("p_partkey", F.round("v.num", 6).alias("feet"), "v.unit")


@query("SELECT 'cust-' || c_custkey AS id, c_name AS dis, '✓' AS customer, '@nation-' || c_nationkey AS equip FROM customer")
def q75_display(spark, d):
    e = where_dynamic(branches(spark, d), tag("customer"))
    return e.select("id", *[kinds.display(F.col("tags")[t]).alias(n) for t, n in (("dis", "dis"), ("customer", "customer"), ("equipRef", "equip"))])


@query("SELECT 'nation-' || n_nationkey AS id, n_name AS dis FROM nation UNION ALL SELECT 'region-' || r_regionkey, r_name FROM region")
def q76_display_name(spark, d):
    return graph.display_name(where_dynamic(branches(spark, d), tag("nation") | tag("region")))


@query("SELECT 'nation-' || n_nationkey AS id, n_name AS dis, 'nation-' || n_nationkey AS nav_id FROM nation WHERE n_regionkey = 2")
def q78_nav_children(spark, d):
    return graph.nav(star(spark, d), "region-2")
