"""Connectors against databases that are really there: SQLite by the Python data source, Derby by JDBC."""

import contextlib
import sqlite3

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlark.sources import connectors
from ledgerlark.sources.catalog import load
from ledgerlark.sql_shapes import largest_groups

SF = "/root/testdata/sf0.001"
SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@pytest.fixture
def database(spark, tmp_path):
    path = f"{tmp_path}/crm.db"
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute('create table "odd ""name" (c_custkey integer, c_name text, c_nationkey integer, c_acctbal real, c_mktsegment text)')
        rows = [tuple(r) for r in load(spark, SF, "customer").collect()] + [(None, "no key", None, None, None)] * 3
        db.executemany('insert into "odd ""name" values (?, ?, ?, ?, ?)', rows)
        db.commit()
    spark.dataSource.register(connectors.Database)
    return path


def options(path, **more):
    return {"database": path, "table": 'odd "name', "key": "c_custkey"} | more


def test_a_table_is_read_by_many_tasks(spark, database):
    read = lambda **more: spark.read.format("database").schema(SCHEMA).options(**options(database, **more)).load()
    df = read(partitions="5", fetch="7")
    assert df.rdd.getNumPartitions() == 6  # one for rows without a key
    want = load(spark, SF, "customer")
    assert df.where("c_custkey is not null").exceptAll(want).count() == 0 and df.count() == want.count() + 3
    assert read(partitions="10000").count() == want.count() + 3
    with pytest.raises(Exception, match="needs database"):
        spark.read.format("database").schema(SCHEMA).load().count()


def test_filters_reach_the_database(spark, database):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("database").schema(SCHEMA).options(**options(database, pushdown="true")).load()
        condition = "c_mktsegment in ('BUILDING', 'it''s') and c_acctbal >= 0 and c_nationkey < 20 and c_name is not null and length(c_name) > 3"
        assert df.where(condition).exceptAll(load(spark, SF, "customer").where(condition)).count() == 0
        assert df.where(condition).count() == load(spark, SF, "customer").where(condition).count() > 0
        assert df.where("c_custkey is null").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_new_rows_come_as_a_stream(spark, database, tmp_path):
    stream = spark.readStream.format("database").schema(SCHEMA).options(**options(database)).load().select("c_custkey")

    def drain():
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/o")
        query.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/o").collect())

    before = sorted(r[0] for r in load(spark, SF, "customer").select("c_custkey").collect())
    assert drain() == before
    with contextlib.closing(sqlite3.connect(database)) as db:
        db.executemany('insert into "odd ""name" (c_custkey) values (?)', [(1_000_000,), (1_000_001,)])
        db.commit()
    assert drain() == [*before, 1_000_000, 1_000_001]


def test_an_empty_table(spark, tmp_path):
    with contextlib.closing(sqlite3.connect(f"{tmp_path}/e.db")) as db:
        db.execute("create table t (k integer)")
    spark.dataSource.register(connectors.Database)
    df = spark.read.format("database").schema("k long").options(database=f"{tmp_path}/e.db", table="t", key="k").load()
    assert df.count() == 0


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/erp;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    parts = load(spark, SF, "part").select(F.col("p_partkey").alias("K"), F.col("p_brand").alias("BRAND"), F.col("p_retailprice").alias("PRICE"))
    connectors.write_jdbc(parts, url, "parts", driver=driver, createTableColumnTypes="BRAND VARCHAR(40)")
    whole = connectors.read_jdbc(spark, url, "parts", driver=driver)
    dealt = connectors.read_jdbc(spark, url, "parts", "K", 4, driver=driver)
    assert dealt.rdd.getNumPartitions() == 4 and whole.rdd.getNumPartitions() == 1
    for df in (whole, dealt):
        assert df.exceptAll(parts).count() == 0 and df.count() == parts.count()
    cheap = dealt.where("PRICE < 1000 and BRAND = 'Brand#2'")
    assert cheap.count() == parts.where("PRICE < 1000 and BRAND = 'Brand#2'").count()
    assert "PushedFilters: [*IsNotNull(PRICE)" in cheap._jdf.queryExecution().executedPlan().toString()
    connectors.write_jdbc(parts.limit(0), url, "nothing", driver=driver)
    assert connectors.read_jdbc(spark, url, "nothing", "K", driver=driver).count() == 0


def test_identifiers_are_bound(spark):
    assert largest_groups(spark, SF, "orders", "o_orderstatus", "o_totalprice", 2).count() == 2
    with pytest.raises(AnalysisException):
        largest_groups(spark, SF, "orders", "o_orderstatus) from x --", "o_totalprice", 2)
