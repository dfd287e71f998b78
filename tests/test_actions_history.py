"""Actions as table functions, saved history, caps and walks on edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators import history, taxonomy, walks
from tagframe.operators.actions import Actions
from tagframe.operators.lineage import folder


def test_actions(spark):
    e = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("c", None)], "id string, n double").select("id", kinds.tags(n=F.when(F.col("n").isNotNull(), kinds.number(F.col("n"))), m=kinds.marker(), s=kinds.string(F.lit("x"))).alias("tags"))
    actions = Actions()
    actions.register("repeat", lambda i, tags, args: [(k, f"{i}{args['end']}{tags['s']}{tags['m']}") for k in range(int(tags.get("n", 1.0)))], "k int, label string")
    assert sorted(map(tuple, actions.invoke(e, "repeat", {"end": "!"}).collect())) == [("a", 0, "a!xTrue"), ("a", 1, "a!xTrue"), ("a", 2, "a!xTrue"), ("c", 0, "c!xTrue")]
    actions.register("repeat", lambda i, tags, args: [(1,)], "k int")
    assert sorted(map(tuple, actions.invoke(e, "repeat").collect())) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(KeyError):
        actions.invoke(e, "none")
    assert actions.names() == ["repeat"]


def rows(seed=1):
    r = random.Random(seed)
    out = [(r.choice(["p", "p", "p", "q", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 200)), i, float(i)) for i in range(400)]
    return out + [("z", dt.datetime(2024, 1, 1), 900 + i, 0.0) for i in range(30)]


SCHEMA = "point_id string, ts timestamp_ntz, ord long, val double"


@pytest.mark.parametrize("cap", [1, 7, 40, 1000])
def test_caps_by_periods(spark, cap):
    data = rows()
    want = []
    for p in {x[0] for x in data}:
        want += sorted((x for x in data if x[0] == p), key=lambda x: (x[1], x[2]), reverse=True)[:cap]
    got = [tuple(x) for x in history.capped(spark.createDataFrame(data, SCHEMA), cap).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_saved_history_prunes_buckets(spark):
    path = folder(spark, "history")
    data = [x for x in rows() if x[0]]
    history.save(spark.createDataFrame(data, SCHEMA), path, buckets=8)
    df = history.read_saved(spark, path, "q", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 6), buckets=8)
    assert [tuple(x) for x in df.select("ord").collect()] and {x["point_id"] for x in df.collect()} == {"q"}
    assert sorted(x["ord"] for x in df.collect()) == sorted(x[2] for x in data if x[0] == "q" and dt.datetime(2024, 1, 3) <= x[1] <= dt.datetime(2024, 1, 6))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "point_id,q" in plan


def test_reachable_in_logarithmic_rounds(spark, monkeypatch):
    chain = spark.range(1, 200).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    made = []
    kept = walks.written
    monkeypatch.setattr(walks, "written", lambda df, name: made.append(name) or kept(df, name))
    got = walks.reachable(chain)
    assert got.count() == 199 * 200 // 2 and got.where(F.col("depth") != F.col("src") - F.col("dst")).count() == 0
    assert len(made) <= 10  # 2^8 steps
    with pytest.raises(ValueError):
        walks.reachable(chain, max_depth=100)


def test_reachable_on_random_graphs(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 14), r.randint(0, 14)) for _ in range(22)]
    want = {}
    for s in range(15):
        level, depth = {s}, 0
        while level:
            depth += 1
            level = {b for a, b in edges if a in level} - {d for (x, d) in want if x == s}
            want |= {(s, d): depth for d in level}
    got = walks.reachable(spark.createDataFrame(edges + [(None, 1)], "src int, dst int"))
    assert {(x["src"], x["dst"]): x["depth"] for x in got.collect()} == want


def test_layers_and_cycles(spark):
    needs = [("app", "ui"), ("ui", "core"), ("app", "core"), ("x", "y"), ("y", "x"), ("z", "x"), ("core", "core0")]
    got = walks.layers(spark.createDataFrame(needs, "node string, needs string"), spark.createDataFrame([("alone",)], "node string"))
    assert {x["node"]: x["layer"] for x in got.collect()} == {"core0": 0, "alone": 0, "core": 1, "ui": 2, "app": 3, "x": None, "y": None, "z": None}
    assert walks.layers(spark.createDataFrame([], "node string, needs string")).count() == 0


def test_a_library_that_others_build_on_stays(spark):
    defs = spark.createDataFrame([("a", "l1", [], [], None, False), ("b", "l2", ["a"], [], None, False)], "symbol string, lib string, is array<string>, tag_on array<string>, of string, mandatory boolean")
    assert [x[0] for x in taxonomy.without_lib(defs, "l2").select("symbol").collect()] == ["a"]
    with pytest.raises(ValueError):
        taxonomy.without_lib(defs, "l1")


def test_more_rows_than_one_write_takes(spark):
    at = F.timestamp_seconds(F.col("id") % 7 * 86_400)
    rows = lambda n, first: spark.range(n).select((F.col("id") % 3).alias("point_id"), at.alias("ts"), (F.col("id") + first).alias("ord"), (F.col("id") + first).cast("double").alias("val"))
    h, n = rows(20, 0), history.WRITE_ROWS + 1
    with pytest.raises(ValueError, match="more than"):
        history.write(h, rows(n, 100), cap=2)
    got = sorted(tuple(r) for r in history.write_all(h, rows(n, 100), cap=2).collect())
    first, rest = rows(n, 100).where(F.col("ord") < 50_000), rows(n, 100).where(F.col("ord") >= 50_000)
    assert got == sorted(tuple(r) for r in history.write(history.write(h, first, cap=2), rest, cap=2).collect())
    assert len(got) == 6
