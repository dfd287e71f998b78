"""More queries: catalogs of types, stores and text grids that Spark derives from the star-schema tables, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.functions import kinds, timezones, units
from tagframe.functions.filters import dict_of, list_of, num, tag
from tagframe.operators import changes, graph, history, ontology, specs, taxonomy, walks
from tagframe.operators.actions import Actions
from tagframe.operators.lineage import folder
from tagframe.operators.store import Store
from tagframe.plans.catalog import branches, change_log, points, query, star, table
from tagframe.plans.compile import where_dynamic
from tagframe.sources import formats

# --- types of parts as a taxonomy ------------------------------------------------------------------


def part_types(spark: SparkSession, d: str) -> DataFrame:
    """Definitions from parts: a part is of its conjunct of type and brand, which is of both; type and brand are of ``part``. Names are tags on types, and a choice is of each type."""
    p = table(spark, d, "part")
    kind, brand = F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    both = F.concat(kind, F.lit("-"), brand)
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, symbol: Column, is_: Column, on: Column = none, of: Column = F.lit(None), mandatory: Column = F.lit(False), lib: str = "lib:parts") -> DataFrame:
        return df.select(symbol.alias("symbol"), F.lit(lib).alias("lib"), is_.alias("is"), on.alias("tag_on"), of.cast("string").alias("of"), mandatory.alias("mandatory"))

    top = rows(p.agg(F.count(F.lit(1)).alias("n")), F.lit("part"), F.array(F.lit("entity")), mandatory=F.lit(True), lib="lib:base")
    types = rows(p.select("p_type").distinct(), kind, F.array(F.lit("part")), mandatory=F.col("p_type").isin("ECONOMY", "SMALL"))
    brands = rows(p.select("p_brand").distinct(), brand, F.array(F.lit("part")))
    pairs = rows(p.select("p_type", "p_brand").distinct(), both, F.array(kind, brand))
    items = rows(p, F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.array(both), lib="lib:items")
    names = rows(p.groupBy("p_name").agg(F.collect_set(F.lower("p_type")).alias("on")), F.concat(F.lit("name:"), F.col("p_name")), none, F.col("on"))
    choice = rows(p.select("p_type").distinct(), F.concat(F.lit("choice:"), kind), F.array(F.lit("choice")), of=kind)
    return top.unionByName(types).unionByName(brands).unionByName(pairs).unionByName(items).unionByName(names).unionByName(choice)


_PARTS = "p AS (SELECT *, lower(p_type) AS kind, replace(lower(p_brand), '#', '') AS brand, lower(p_type) || '-' || replace(lower(p_brand), '#', '') AS pair, 'part:' || p_partkey AS item FROM part)"
_IS = """is_a AS (SELECT 'part' AS symbol, 'entity' AS parent UNION SELECT kind, 'part' FROM p UNION SELECT brand, 'part' FROM p UNION SELECT pair, kind FROM p UNION SELECT pair, brand FROM p
UNION SELECT item, pair FROM p UNION SELECT 'choice:' || kind, 'choice' FROM p)"""
_DEFS = "d AS (SELECT DISTINCT symbol FROM is_a UNION SELECT 'name:' || p_name FROM p)"
_CLOSED = f"""{_PARTS}, {_IS}, {_DEFS}, up AS (SELECT symbol, parent AS ancestor, 1 AS depth FROM is_a UNION ALL SELECT up.symbol, is_a.parent, depth + 1 FROM up JOIN is_a ON up.ancestor = is_a.symbol),
c AS (SELECT symbol, symbol AS ancestor, 0 AS depth FROM d UNION ALL SELECT symbol, ancestor, min(depth) FROM up GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_CLOSED} SELECT symbol, ancestor, depth FROM c")
def q40_taxonomy_closure(spark, d):
    return ontology.closure(part_types(spark, d))


@query(f"WITH RECURSIVE {_CLOSED}, w AS (SELECT item AS symbol, kind AS other FROM p UNION ALL SELECT item, 'small' FROM p UNION ALL SELECT item, 'entity' FROM p UNION ALL SELECT item || '?', item || '?' FROM p) SELECT w.symbol, w.other, c.symbol IS NOT NULL OR w.symbol = w.other AS is_a FROM w LEFT JOIN c ON w.symbol = c.symbol AND w.other = c.ancestor")
def q79_is_a(spark, d):
    p, ident = table(spark, d, "part"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    pair = lambda a, b: p.select(a.alias("symbol"), b.alias("other"))
    unknown = F.concat(ident, F.lit("?"))
    pairs = pair(ident, F.lower("p_type")).unionByName(pair(ident, F.lit("small"))).unionByName(pair(ident, F.lit("entity"))).unionByName(pair(unknown, unknown))
    return taxonomy.is_a(pairs, taxonomy.closed(part_types(spark, d)))


@query(f"WITH RECURSIVE {_CLOSED} SELECT parent AS symbol, false AS deep, symbol AS subtype FROM is_a UNION ALL SELECT ancestor, true, symbol FROM c WHERE depth > 0")
def q80_subtypes(spark, d):
    defs = part_types(spark, d)
    direct, deep = taxonomy.subtypes(defs), taxonomy.subtypes(defs, taxonomy.closed(defs))
    return direct.withColumn("deep", F.lit(False)).unionByName(deep.withColumn("deep", F.lit(True)))


@query(f"WITH {_PARTS} SELECT DISTINCT pair AS symbol, t.pos, CASE t.pos WHEN 1 THEN kind ELSE brand END AS part FROM p, (VALUES (1), (2)) t(pos)")
def q81_conjuncts(spark, d):
    pairs = part_types(spark, d).where(taxonomy.kind(F.col("symbol"), F.col("is")) == "conjunct")
    return pairs.select("symbol", F.posexplode(ontology.conjunct_parts(F.col("symbol"))).alias("pos", "part")).select("symbol", (F.col("pos") + 1).alias("pos"), "part")


@query(f"WITH {_PARTS}, {_IS}, {_DEFS} SELECT 'def' AS list, symbol AS name FROM d UNION ALL SELECT 'lib', unnest(['lib:base', 'lib:items', 'lib:parts']) UNION ALL SELECT 'search', symbol FROM d WHERE contains(symbol, 'brand1')")
def q82_listings(spark, d):
    return taxonomy.listing(part_types(spark, d), "brand1")


@query(f"WITH RECURSIVE {_CLOSED} SELECT symbol, ancestor AS tag FROM c WHERE ancestor IN ('part', 'economy', 'small')")
def q83_mandatory(spark, d):
    defs = part_types(spark, d)
    return taxonomy.required(defs, taxonomy.closed(defs))


@query(f"WITH RECURSIVE {_CLOSED} SELECT DISTINCT c.symbol, 'name:' || p_name AS tag FROM c JOIN p ON c.ancestor = p.kind")
def q84_tags_for(spark, d):
    defs = part_types(spark, d)
    return taxonomy.tags_for(defs, taxonomy.closed(defs))


@query(f"WITH RECURSIVE {_CLOSED} SELECT 'choice:' || ancestor AS symbol, symbol AS choice FROM c WHERE depth > 0 AND ancestor IN (SELECT kind FROM p) UNION ALL SELECT parent, symbol FROM is_a WHERE parent IN (SELECT symbol FROM d) AND parent NOT LIKE 'choice:%'")
def q85_choices(spark, d):
    defs = part_types(spark, d)
    return taxonomy.choices(defs, taxonomy.closed(defs))


@query(f"WITH {_PARTS}, {_IS}, {_DEFS} SELECT symbol, CASE WHEN symbol LIKE 'choice:%' THEN 'choice' WHEN symbol = 'part' THEN 'entity' WHEN contains(symbol, '-') THEN 'conjunct' ELSE 'marker' END AS kind FROM d")
def q86_def_kinds(spark, d):
    return part_types(spark, d).select("symbol", taxonomy.kind(F.col("symbol"), F.col("is")).alias("kind"))


@query(f"WITH {_PARTS}, {_IS}, {_DEFS} SELECT symbol FROM d WHERE symbol NOT IN (SELECT item FROM p)")
def q87_without_lib(spark, d):
    return taxonomy.without_lib(part_types(spark, d), "lib:items").select("symbol")


@query("""SELECT 'part-' || p_partkey AS id, lower(p_type) AS symbol FROM part WHERE p_size > 10 AND p_type IN ('ECONOMY', 'SMALL') UNION ALL SELECT 'part-' || p_partkey, 'part' FROM part WHERE p_size > 10
UNION ALL SELECT 'part-' || p_partkey, t.s FROM part, (SELECT DISTINCT lower(p_type) AS s FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')) t WHERE p_size > 10""")
def q88_fitting(spark, d):
    """Which types each part has the tags of; large ones are marked as parts."""
    p = table(spark, d, "part")
    marks = F.array(F.lower("p_type"), F.when(F.col("p_size") > 10, "part"))
    e = p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.map_from_entries(F.transform(F.array_compact(marks), lambda t: F.struct(t, kinds.marker()))).alias("tags"))
    defs = part_types(spark, d)
    needs = taxonomy.required(defs, taxonomy.closed(defs)).join(p.select(F.lower("p_type").alias("symbol")).union(p.select(F.lit("part"))).distinct(), "symbol", "left_semi")
    return taxonomy.fitting(e, needs)


@query("""WITH k AS (SELECT DISTINCT lower(p_type) AS kind FROM part), own AS (SELECT lower(p_type) AS kind, max(p_size) AS top FROM part GROUP BY 1)
SELECT 'base' AS spec, 'size' AS slot, 50 AS most, 'base' AS of UNION ALL SELECT 'base', 'price', 99, 'base' UNION ALL SELECT kind, 'size', top, kind FROM own UNION ALL SELECT kind, 'price', 99, 'base' FROM k
UNION ALL SELECT DISTINCT lower(p_type) || '/' || p_brand, 'size', top, lower(p_type) FROM part JOIN own ON kind = lower(p_type) UNION ALL SELECT DISTINCT lower(p_type) || '/' || p_brand, 'price', max(p_size) OVER (PARTITION BY p_type, p_brand), lower(p_type) || '/' || p_brand FROM part""")
def q65_effective_slots(spark, d):
    """Slots of a spec a type and brand, of its type and of a base, the nearest standing for those above."""
    p = table(spark, d, "part")
    kind, pair = F.lower("p_type"), F.concat(F.lower("p_type"), F.lit("/"), F.col("p_brand"))
    base = p.agg(F.lit("base").alias("spec"), F.lit(None).cast("string").alias("base"))
    bases = base.unionByName(p.select(kind.alias("spec"), F.lit("base").alias("base")).distinct()).unionByName(p.select(pair.alias("spec"), kind.alias("base")).distinct())
    top = base.select("spec", F.explode(F.expr("map('size', 50, 'price', 99)")).alias("slot", "most"))
    own = lambda spec, slot: p.groupBy(spec.alias("spec")).agg(F.max("p_size").cast("int").alias("most")).select("spec", F.lit(slot).alias("slot"), "most")
    return taxonomy.inherited_slots(bases, top.unionByName(own(kind, "size")).unionByName(own(pair, "price")))


# --- walks -----------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 2 AS n FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 97 = 0),
bad AS (SELECT k FROM e WHERE k = n UNION SELECT e.k FROM e JOIN bad ON e.n = bad.k),
l AS (SELECT p_partkey AS k, 0 AS layer FROM part WHERE p_partkey <= 1 UNION SELECT e.k, layer + 1 FROM e JOIN l ON e.n = l.k WHERE e.k <> e.n)
SELECT 'part-' || k AS node, CASE WHEN k NOT IN (SELECT k FROM bad) THEN max(layer) END AS layer FROM (SELECT k, layer FROM l UNION ALL SELECT p_partkey, NULL FROM part) GROUP BY k""")
def q89_dependency_layers(spark, d):
    """Parts need those of half and of a third of their number; every 97th needs itself, a cycle."""
    key = F.col("p_partkey")
    ident = lambda k: F.concat(F.lit("part-"), k.cast("bigint").cast("string"))
    p = table(spark, d, "part")
    needs = lambda on, to: p.where(on).select(ident(key).alias("node"), ident(to).alias("needs"))
    edges = needs(key > 1, F.floor(key / 2)).unionByName(needs(key > 2, F.floor(key / 3))).unionByName(needs((key > 0) & (key % 97 == 0), key))
    return walks.layers(edges, p.select(ident(key).alias("node")))


@query("SELECT a.p_partkey AS src, b.p_partkey AS dst, a.p_partkey - b.p_partkey AS depth FROM part a JOIN part b ON b.p_partkey < a.p_partkey AND a.p_partkey // 100 = b.p_partkey // 100")
def q90_long_chains(spark, d):
    """Each part follows the one before it, a hundred in a chain: seven rounds of doubling."""
    key = F.col("p_partkey")
    return walks.reachable(table(spark, d, "part").where(key % 100 > 0).select(key.alias("src"), (key - 1).alias("dst")))


# --- a store that writes its own change log --------------------------------------------------------


def written_store(spark: SparkSession, d: str) -> tuple[Store, int]:
    """Customers and nations are added; then suppliers come, every third customer changes and every fifth nation goes. The store, and the version between."""
    e = star(spark, d)
    of = lambda tag: e.where(F.map_contains_key("tags", F.lit(tag)))
    store = Store(spark, folder(spark, "store"), buckets=16)
    first = store.write(of("customer").unionByName(of("nation")).select("id", F.lit("add").alias("op"), "tags"))
    key = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    change = F.create_map(F.lit("dis"), kinds.string(F.lit("VIP")), F.lit("segment"), kinds.value("remove"), F.lit("since"), kinds.number(key))
    updates = of("customer").where(key % 3 == 0).select("id", F.lit("upsert").alias("op"), change.alias("tags"))
    gone = of("nation").where(key % 5 == 0).select("id", F.lit("remove").alias("op"), F.expr("map()").cast(kinds.TAGS).alias("tags"))
    store.write(of("supplier").select("id", F.lit("upsert").alias("op"), "tags").unionByName(updates).unionByName(gone))
    return store, first


_WRITES = """w1 AS (SELECT 'cust-' || c_custkey AS ref, 'add' AS op FROM customer UNION ALL SELECT 'nation-' || n_nationkey, 'add' FROM nation),
w2 AS (SELECT 'supp-' || s_suppkey AS ref, 'add' AS op, NULL AS before, s_name AS dis FROM supplier UNION ALL SELECT 'cust-' || c_custkey, 'update', c_mktsegment, 'VIP' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'nation-' || n_nationkey, 'remove', NULL, n_name FROM nation WHERE n_nationkey % 5 = 0)"""


@query(f"WITH {_WRITES} SELECT (SELECT count(*) FROM w1) + row_number() OVER (ORDER BY ref) AS version, op, ref, before AS segment_before, dis, op = 'update' AS segment_gone FROM w2")
def q91_written_log(spark, d):
    """What the second write logged: versions go on where the first ended, updates know what was there."""
    store, first = written_store(spark, d)
    log = store.log(first)
    return log.select("version", "op", "ref", F.col("previous")["segment"].str.alias("segment_before"), F.coalesce("new", "changed", "old")["dis"].str.alias("dis"), F.coalesce(F.col("changed")["segment"].kind == "remove", F.lit(False)).alias("segment_gone"))


_AFTER = """SELECT 'supp-' || s_suppkey AS id, s_name AS dis, NULL AS segment, NULL AS since FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, n_name, NULL, NULL FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'cust-' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'VIP' ELSE c_name END, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::DOUBLE END FROM customer"""


def _seen(e: DataFrame) -> DataFrame:
    t = F.col("tags")
    return e.select("id", t["dis"].str.alias("dis"), t["segment"].str.alias("segment"), t["since"].num.alias("since"))


@query(_AFTER)
def q92_replay_of_own_log(spark, d):
    return _seen(changes.replay(written_store(spark, d)[0].log()))


@query(_AFTER)
def q93_stored_entities(spark, d):
    return _seen(written_store(spark, d)[0].entities())


# --- text grids, written and read again ------------------------------------------------------------

_CUSTOMERS = "SELECT 'cust-' || c_custkey AS id, c_name AS dis, c_acctbal AS acctbal, 'USD' AS unit, c_mktsegment AS segment, 'nation-' || c_nationkey AS equip, true AS customer FROM customer"


def _customers(spark, d) -> DataFrame:
    e = star(spark, d).where(F.map_contains_key("tags", F.lit("customer")))
    return e.select("id", F.map_concat(F.create_map(F.lit("id"), kinds.ref(F.col("id"))), "tags").alias("tags"))


def _again(spark, d, mime: str) -> DataFrame:
    path = folder(spark, "grid")
    formats.write(_customers(spark, d), path, mime)
    t = F.col("tags")
    rows = graph.from_rows(formats.READERS[mime](spark, path, 1 << 16), "pos")
    return rows.select("id", t["dis"].str.alias("dis"), t["acctbal"].num.alias("acctbal"), t["acctbal"].unit.alias("unit"), t["segment"].str.alias("segment"), t["equipRef"].str.alias("equip"), (t["customer"].kind == "marker").alias("customer"))


@query(_CUSTOMERS)
def q94_zinc_files(spark, d):
    return _again(spark, d, formats.ZINC)


@query(_CUSTOMERS)
def q95_trio_files(spark, d):
    return _again(spark, d, formats.TRIO)


@query(_CUSTOMERS)
def q96_json4_files(spark, d):
    return _again(spark, d, formats.JSON4)


@query(_CUSTOMERS)
def q97_json3_files(spark, d):
    return _again(spark, d, formats.JSON3)


@query('''SELECT '"@cust-' || c_custkey || '","' || printf('%.2f', c_acctbal).rtrim('0').rtrim('.') || 'USD","M","""' || c_name || '"""' AS line FROM customer''')
def q98_csv_lines(spark, d):
    rows = formats.csv_lines(_customers(spark, d), ["id", "acctbal", "customer", "dis"])
    return rows.select(F.col("value").alias("line"))


@query("SELECT 'n' || n_nationkey AS column, 'dis' AS tag, n_name AS text FROM nation UNION ALL SELECT 'n' || n_nationkey, 'hidden', NULL FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT NULL, 'about', (SELECT max(r_name) FROM region)")
def q99_grid_meta(spark, d):
    """A column a nation with meta, and meta of the grid, written as Zinc and read from the files' heads."""
    n = table(spark, d, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    meta = n.select(name.alias("column"), F.lit("dis").alias("tag"), kinds.string(F.col("n_name")).alias("value")).unionByName(n.where("n_nationkey % 2 = 0").select(name.alias("column"), F.lit("hidden").alias("tag"), kinds.marker().alias("value")))
    meta = meta.unionByName(table(spark, d, "region").agg(F.max("r_name").alias("m")).select(F.lit(None).cast("string").alias("column"), F.lit("about").alias("tag"), kinds.string(F.col("m")).alias("value")))
    rows = n.select(F.concat(F.lit("row-"), name).alias("id"), F.map_from_entries(F.array(F.struct(name, kinds.number(F.col("n_nationkey"))))).alias("tags"))
    path = folder(spark, "grid")
    formats.write(rows, path, formats.ZINC, meta)
    return formats.read_meta(spark, path).select("column", "tag", F.col("value").str.alias("text")).distinct()


@query("SELECT 'cust-' || c_custkey AS id, c_name AS dis FROM customer UNION ALL SELECT 'supp-' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, n_name FROM nation UNION ALL SELECT 'region-' || r_regionkey, r_name FROM region")
def q100_every_entity(spark, d):
    """The empty filter takes all."""
    return graph.display_name(star(spark, d))


# --- functions and watches -------------------------------------------------------------------------


def _of(key: Column, *names: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


@query("SELECT n_nationkey, t.name, t.zone FROM nation JOIN (VALUES (0, 'New_York', 'America/New_York'), (1, 'America/Chicago', 'America/Chicago'), (2, 'Nowhere', NULL), (3, 'UTC', 'Etc/UTC')) t(k, name, zone) ON n_nationkey % 4 = k")
def q57_zones(spark, d):
    n = table(spark, d, "nation").withColumn("name", _of(F.col("n_nationkey"), "New_York", "America/Chicago", "Nowhere", "UTC"))
    return n.select("n_nationkey", "name", timezones.zone_for(F.col("name")).alias("zone"))


@query("SELECT p_partkey, t.* EXCLUDE k FROM part JOIN (VALUES (0, '°F', 'temperature', 'fahrenheit', 'celsius'), (1, 'kWh', 'energy', 'kilowatt_hour', 'joule'), (2, 'psi', 'pressure', 'pounds_per_square_inch', 'pascal'), (3, 'none', NULL, NULL, NULL)) t(k, symbol, quantity, unit, base) ON p_size % 4 = k")
def q74_unit_registry(spark, d):
    symbol = F.col("symbol")
    p = table(spark, d, "part").select("p_partkey", _of(F.col("p_size"), "°F", "kWh", "psi", "none").alias("symbol"))
    return p.select("p_partkey", "symbol", units.quantity(symbol).alias("quantity"), units.unit_name(symbol).alias("unit"), units.base_unit(units.quantity(symbol)).alias("base"))


@query("SELECT doc_id, regexp_full_match(text, '[A-Za-z0-9_:.~-]+') AS valid FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1 - p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9_:.~-]+') FROM part UNION ALL SELECT -1000000 - p_partkey, true FROM part")
def q77_ref_valid(spark, d):
    """Whole texts, brands with a sign that no id may have, and types."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", kinds.ref_is_valid(F.col("text")).alias("valid"))
    p = table(spark, d, "part")
    at = lambda n, c: p.select((F.lit(n) - F.col("p_partkey")).alias("doc_id"), kinds.ref_is_valid(F.col(c)).alias("valid"))
    return docs.unionByName(at(-1, "p_brand")).unionByName(at(-1_000_000, "p_type"))


@query("""SELECT 'w-' || c_nationkey AS watch_id, 'me' AS owner, 'cust-' || c_custkey AS id, 7::BIGINT AS last_version FROM customer WHERE c_nationkey < 2 AND c_custkey % 3 <> 0
UNION ALL SELECT 'w-0', 'me', 'supp-' || s_suppkey, 7 FROM supplier WHERE s_nationkey = 0""")
def q71_watch_ids(spark, d):
    """Watches on the customers of three nations: one gets its suppliers, two lose every third id, and one ends."""
    c = table(spark, d, "customer")
    ident = F.concat(F.lit("cust-"), F.col("c_custkey").cast("string"))
    watches = spark.createDataFrame([], "watch_id string, owner string, id string, last_version long")
    of = lambda n: c.where(F.col("c_nationkey") == n)
    for n in (0, 1, 2):
        watches = changes.subscribe(watches, f"w-{n}", "me", of(n).select(ident.alias("id")), 7, limited=False)
    watches = changes.watch_ids(watches, "w-0", "me", table(spark, d, "supplier").where("s_nationkey = 0").select(F.concat(F.lit("supp-"), F.col("s_suppkey").cast("string")).alias("id")), limited=False)
    for n in (0, 1):
        watches = changes.unwatch_ids(watches, f"w-{n}", "me", of(n).where("c_custkey % 3 = 0").select(ident.alias("id")))
    return changes.unsubscribe(watches, "w-2", "me")


@query("SELECT 'o-' || (user_id % 4) AS owner, count(DISTINCT event_type) AS watches, count(DISTINCT (event_type, user_id)) AS ids FROM events GROUP BY 1")
def q101_totals_of_owners(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("o-"), (F.col("user_id") % 4).cast("string")).alias("owner"), F.col("event_type").alias("watch_id"), F.col("user_id").cast("string").alias("id")).distinct()
    return changes.totals(e)


@query("SELECT version, op, ref FROM (SELECT event_id + 1 AS version, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'add' WHEN event_id % 50 = 0 THEN 'remove' ELSE 'update' END AS op, 'user-' || user_id AS ref FROM events) WHERE version > 100 ORDER BY version LIMIT 500")
def q102_rows_of_a_poll(spark, d):
    rows, more = changes.poll_rows(change_log(spark, d), 100, rows=500)
    return rows.select("version", "op", "ref")


_SIZED = {"Sized": specs.Spec("Sized", None, [specs.Slot("size", "Number", min_val=5.0), specs.Slot("dis", "Number"), specs.Slot("brand", "Str"), specs.Slot("other", "Own::Thing")])}


@query("SELECT 'part-' || p_partkey AS id, 'wrong_type' AS issue, 'dis' AS slot FROM part UNION ALL SELECT 'part-' || p_partkey, 'constraint', 'size' FROM part WHERE p_size < 5")
def q103_slot_types(spark, d):
    """A slot of another kind is an issue, a missing one and one of an unknown type are none."""
    p = table(spark, d, "part")
    e = p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), kinds.tags(size=kinds.number(F.col("p_size")), dis=kinds.string(F.col("p_name")), brand=F.when(F.col("p_size") > 9, kinds.string(F.col("p_brand"))), other=kinds.boolean(F.lit(True))).alias("tags"))
    return specs.check(e, _SIZED, "Sized")


# --- actions and saved history ---------------------------------------------------------------------


def _instalments(ident, tags, args):
    n = int(args["n"])
    for i in range(n):
        yield i + 1, tags["acctbal"] / n, f"{tags['dis']}/{i + 1}"


ACTIONS = Actions()
ACTIONS.register("instalments", _instalments, "n int, amount double, label string")


@query("SELECT 'cust-' || c_custkey AS id, t.n, c_acctbal / 3 AS amount, c_name || '/' || t.n AS label FROM customer, (VALUES (1), (2), (3)) t(n) WHERE c_acctbal > 5000")
def q104_invoke_action(spark, d):
    """Three rows a customer from a registered action."""
    e = where_dynamic(branches(spark, d), tag("acctbal") > num(5000, "USD"))
    return ACTIONS.invoke(e, "instalments", {"n": 3})


@query("SELECT user_id AS point_id, ts, value AS val FROM events WHERE user_id = 11 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-19 23:59:59'")
def q105_saved_history(spark, d):
    """Saved by buckets; a point's rows come from its bucket alone."""
    path = folder(spark, "history")
    history.save(points(spark, d), path, buckets=32)
    start, end = history.parse_range("2024-01-03,2024-01-19")
    return history.read_saved(spark, path, 11, start, end, buckets=32).select("point_id", "ts", "val")


# --- lists and dicts in cells ----------------------------------------------------------------------


def _nested_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose Zinc cell ``flags`` is a list by line number, flag and status of a dict of status and return flag for each line, names in either order."""
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    first = F.concat(F.lit('{s:"'), "l_linestatus", F.lit('" r:"'), "l_returnflag", F.lit('"}'))
    second = F.concat(F.lit('{ r:"'), "l_returnflag", F.lit('", s:"'), "l_linestatus", F.lit('" }'))
    cell = F.when(F.col("l_linenumber") % 2 == 0, first).otherwise(second)
    lines = n.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", cell.alias("cell")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.col("x.cell"), ", "), F.lit("]"))
    return lines.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("id"), F.create_map(F.lit("flags"), formats.zinc_decode(text)).alias("tags"))


@query("SELECT 'order-' || l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber) = 'NO,NO'")
def q106_nested_equal(spark, d):
    """Orders of just two lines, both new and open, by deep equality of a list of dicts."""
    line = dict_of(r="N", s="O")
    return where_dynamic(_nested_orders(spark, d), tag("flags") == list_of(line, line)).select("id")


@query("""SELECT 'order-' || l_orderkey AS id, '[' || string_agg('{r:"' || l_returnflag || '",s:"' || l_linestatus || '"}', ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) || ']' AS zinc FROM lineitem GROUP BY l_orderkey""")
def q107_nested_through_json(spark, d):
    """Lists of dicts from Zinc to the prefix form of JSON, read back and written as Zinc."""
    e = _nested_orders(spark, d).select("id", formats.json3_encode(F.col("tags")["flags"]).alias("json"))
    return e.select("id", formats.zinc_encode(formats.json3_decode(F.col("json"))).alias("zinc"))
