"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items() if k.startswith("q")}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(v) if isinstance(v, list) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    c = db.execute(SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, c.fetchall())


def test_both_zeros_are_no_balance(spark, tmp_path):
    for name in ("region", "nation", "supplier"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    zero = F.when(F.col("c_custkey") % 3 == 0, F.lit(-0.0)).when(F.col("c_custkey") % 3 == 1, F.lit(0.0)).otherwise(F.col("c_acctbal"))
    spark.read.parquet(f"{SF}/customer.parquet").withColumn("c_acctbal", zero).write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(r["id"] for r in entry.queries()["q51_dynamic_ne_unit"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    for name, at in (("customer", "customer.parquet/*.parquet"), ("supplier", "supplier.parquet")):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{at}'")
    assert got == sorted(r[0] for r in c.execute(SQL["q51_dynamic_ne_unit"]).fetchall())
    assert not any(i.startswith("cust-") and int(i[5:]) % 3 < 2 for i in got)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
