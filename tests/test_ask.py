"""Questions in SQL, values of large dimensions, answers verified by their own job, freshness from footers."""

import datetime
import shutil
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.nl import ask as asking
from ledgerlark.nl.ask import Conversation, Declined, ask, ask_sql, define, to_spec
from ledgerlark.nl.values import Values, candidates, deletions, index_of, save_index
from ledgerlark.plans.spec import ClarifyNeeded, QuerySpec, Refused, from_json, told_as_json
from ledgerlark.sources import catalog

SF = "/root/testdata/sf0.001"


def test_sql_has_the_rows_of_questions(spark):
    got = ask_sql(spark, SF, "select r.region, 'not ask(''x'') {here}' as s from ask('revenue by region') r where order_revenue > :x", x=0)
    assert sorted(r.region for r in got.collect()) == sorted(r.region for r in asking.rows_of(spark, SF, "revenue by region").collect())
    assert got.first().s == "not ask('x') {here}"
    both = ask_sql(spark, SF, "SELECT count(*) AS n FROM ASK('orders by year') a JOIN ask ( 'revenue by year' ) b ON a.year = b.year")
    assert both.first().n == asking.rows_of(spark, SF, "orders by year").count()
    assert ask_sql(spark, SF, "select 1 as task").first().task == 1


def test_a_refusal_is_a_typed_error(spark):
    with pytest.raises(Declined) as e:
        ask_sql(spark, SF, "select * from ask('what is the weather')")
    assert isinstance(e.value.told, Refused) and "weather" in str(e.value)
    with pytest.raises(Declined) as e:
        ask_sql(spark, SF, "select * from ask('revenu by region')")
    assert isinstance(e.value.told, ClarifyNeeded) and "revenue" in e.value.told.options
    with pytest.raises(Declined):
        define(spark, SF, "weather", "what is the weather")


def test_questions_as_functions(spark):
    define(spark, SF, "by_segment", "customers by segment")
    assert spark.sql("select sum(customer_count) as n from by_segment()").first().n == 150
    with pytest.raises(ValueError):
        define(spark, SF, "x() returns int; drop", "customers by segment")


def levenshtein(a, b):
    return asking.distance(a, b)


@given(st.text("abc", min_size=4, max_size=7), st.text("abc", min_size=4, max_size=7))
def test_words_an_edit_apart_share_a_deletion(a, b):
    if levenshtein(a, b) <= 1:
        assert deletions(a) & deletions(b)


def test_candidates_equal_a_loop(spark):
    index = index_of(spark, SF)
    values = {(r.dimension, r.value) for r in index.select("dimension", "value").collect()}
    words = ["Suplier#000000003", "customer#000000007", "blue  bolt", "bolt", "x", "", "BRAND#2", "Brand#222"]
    got = candidates(index, spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(w, d, v, levenshtein(w.lower(), v.lower())) for w in words for d, v in values if levenshtein(w.lower(), v.lower()) <= 1 and (min(len(w), len(v)) >= 4 or w.lower() == v.lower())}
    assert {tuple(r) for r in got.collect()} == want


def test_misspelt_values_are_asked_back(spark):
    spark.sql("drop table if exists value_index")
    save_index(spark, SF, "value_index", 4)
    values = Values(spark.read.table("value_index"))
    spec = to_spec("revenue of Customer#000000012 by year", values=values)
    assert spec.where[0].value == "Customer#000000012" and spec.by == ("year",)
    asked = to_spec("revenue for custmer#000000012", values=values)
    assert isinstance(asked, ClarifyNeeded) and asked.options == ("customer Customer#000000012",)
    assert to_spec("quantity of blue bolt", values=values).where[0] == to_spec("units for blue bolt please", values=values).where[0]
    assert isinstance(to_spec("revenue of nobody-at-all", values=values), Refused)
    assert isinstance(to_spec("revenue of Customer#000000012"), Refused)  # without an index only the catalog is known
    got = ask(spark, SF, "revenue of customer#000000012", values=values)
    assert got.rows.count() == 1 and "parts add up" not in got.verified.partition("failed")[2]
    spark.sql("drop table value_index")


def test_conversations_are_stored_and_go_on(spark, tmp_path):
    talk = Conversation()
    for q in ("revenue by region", "what about the moon", "revenu", "only 1997", "in asia and europe"):
        talk.hear(q)
    talk.save(spark, f"{tmp_path}/talks", 3)
    Conversation([("orders", QuerySpec(("order_count",)))]).save(spark, f"{tmp_path}/talks", 4)
    again = Conversation.load(spark, f"{tmp_path}/talks", 3)
    assert again.turns == talk.turns and again.hear("by nation") == talk.hear("by nation")
    assert spark.read.parquet(f"{tmp_path}/talks").count() == 6
    for told in (Refused("no"), ClarifyNeeded("which?", ("a", "b")), talk.last):
        assert from_json(told_as_json(told)) == told


@pytest.fixture
def copy_of_tables(tmp_path):
    for p in Path(SF).glob("*.parquet"):
        shutil.copy(p, tmp_path)
    return str(tmp_path)


def replaced(spark, folder, name, change):
    df = change(catalog.load(spark, SF, name))
    shutil.move(f"{folder}/{name}.parquet", f"{folder}/{name}.old")
    df.write.parquet(f"{folder}/{name}.parquet")


def failed(got):
    return {c.name for c in got.checks if not c.passed}


def test_an_answer_is_verified_by_its_own_job(spark, copy_of_tables):
    got = ask(spark, copy_of_tables, "revenue by nation in asia")
    assert not failed(got) and len(got.checks) == 4
    assert got.provenance.plan.count("o_totalprice") >= 1 and got.provenance.plan.count("CollectMetrics") == 4
    assert sum("o_orderkey" in line and "Relation" in line for line in got.provenance.plan.splitlines()) <= 1
    got.rows.unpersist()
    replaced(spark, copy_of_tables, "customer", lambda df: df.where("c_custkey <> 7"))
    lost = ask(spark, copy_of_tables, "revenue by nation")
    assert failed(lost) == {"keys have partners", "no nulls"} and "o_custkey in customer" in lost.verified
    replaced(spark, copy_of_tables, "nation", lambda df: df.union(df.where("n_nationkey = 3")))
    twice = ask(spark, copy_of_tables, "revenue by nation in asia")
    assert "joins keep the grain" in failed(twice)


def test_a_planted_null_is_told(spark, copy_of_tables):
    replaced(spark, copy_of_tables, "nation", lambda df: df.withColumn("n_name", F.when(F.col("n_nationkey") != 4, F.col("n_name"))))
    got = ask(spark, copy_of_tables, "customers by nation")
    assert failed(got) == {"no nulls"} and "null nation" in got.verified


def test_freshness_reads_footers_where_they_tell(spark, tmp_path):
    schema = catalog.SCHEMAS["orders"]
    want = catalog.load(spark, SF, "orders").agg(F.max("o_orderdate")).first()[0]
    assert catalog.latest(spark, f"{SF}/orders.parquet", schema, "o_orderdate") == want
    assert "FileScan" not in catalog.freshness(spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = catalog.load(spark, SF, "orders")
    other = [rows[c] for c in reversed(rows.columns)]
    rows.select(*other).write.parquet(f"{tmp_path}/other")  # another order of columns: scanned
    assert catalog.latest(spark, f"{tmp_path}/other", schema, "o_orderdate") == want
    rows.repartition(5).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))).write.parquet(f"{tmp_path}/some")
    assert catalog.latest(spark, f"{tmp_path}/some", schema, "o_orderdate") == rows.where("o_orderkey % 2 = 0").agg(F.max("o_orderdate")).first()[0]
    rows.limit(0).write.parquet(f"{tmp_path}/none")
    assert catalog.latest(spark, f"{tmp_path}/none", schema, "o_orderdate") is None
    early = spark.createDataFrame([(1, datetime.datetime(1950, 1, 1))], "o_orderkey long, o_orderdate timestamp_ntz")
    early.write.parquet(f"{tmp_path}/early")
    assert catalog.latest(spark, f"{tmp_path}/early", early.schema, "o_orderdate") == datetime.datetime(1950, 1, 1)
