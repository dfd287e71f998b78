from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators import joins, taxonomy


def _entities(spark, rows):
    names = spark.createDataFrame(rows, "id string, names array<string>")
    return names.select("id", F.map_from_entries(F.transform("names", lambda t: F.struct(t, kinds.marker()))).alias("tags"))


def test_rows_of_one_key_are_parted(spark):
    many = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), "id")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "key string, n int")
    got = joins.dealt_join(many, few, "key", most=50)
    assert got.columns == many.join(few, "key").columns
    assert sorted(got.collect()) == sorted(many.join(few, "key").collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in joins.dealt_join(many, few, "key", most=50).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(parts) < sum(parts)


def test_fitting_with_a_tag_that_most_have(spark):
    rows = [(f"e{i}", [t for t, has in (("part", i % 10 > 0), ("a", i % 3 == 0), ("b", i % 5 == 0)) if has]) for i in range(600)]
    needs = {"x": {"part"}, "y": {"part", "a"}, "z": {"a", "b", "part"}, "w": {"a", "unheard"}}
    table = spark.createDataFrame([(s, t) for s, ts in needs.items() for t in ts], "symbol string, tag string")
    got = taxonomy.fitting(_entities(spark, rows), table, most=50).collect()
    assert sorted(map(tuple, got)) == sorted((i, s) for i, tags in rows for s, ts in needs.items() if ts <= set(tags))


def test_fitting_looks_at_each_of_equal_ids(spark):
    twice = _entities(spark, [("e", ["a", "b"]), ("e", ["a"]), ("f", ["b"])])
    needs = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "symbol string, tag string")
    assert sorted(map(tuple, taxonomy.fitting(twice, needs).collect())) == [("e", "t"), ("e", "u"), ("e", "u")]
