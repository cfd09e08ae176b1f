import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark import answer as answers
from ledgerlark.functions.udfs import register_functions
from ledgerlark.nl.ask import Conversation, ask, parse, to_spec
from ledgerlark.operators import joins
from ledgerlark.plans.compile import check, compile_spec
from ledgerlark.plans.spec import CATALOG, Catalog, ClarifyNeeded, Filter, QuerySpec, Refused
from ledgerlark.sources import connectors
from ledgerlark.streaming import refresh, serving

SF = "/root/testdata/sf0.001"

GOLD = {
    "What is the total revenue?": QuerySpec(("order_revenue",)),
    "Show revenue by region": QuerySpec(("order_revenue",), ("region",)),
    "number of orders by priority in Asia": QuerySpec(("order_count",), ("priority",), (Filter("region", "=", "ASIA"),)),
    "top 3 countries by sales": QuerySpec(("order_revenue",), ("nation",), limit=3),
    "share of customers by segment": QuerySpec(("customer_count",), ("segment",), share=True),
    "revenue vs invoiced by year": QuerySpec(("order_revenue", "line_revenue"), ("year",)),
    "events in january 2024 by event type": QuerySpec(
        ("event_count",), ("event_type",), (Filter("day", ">=", "2024-01-01"), Filter("day", "<", "2024-02-01"))
    ),
    "urgent orders": QuerySpec(("order_count",), (), (Filter("priority", "=", "1-URGENT"),)),
    "revenue for building and machinery": QuerySpec(
        ("order_revenue",), (), (Filter("segment", "in", ("BUILDING", "MACHINERY")),)
    ),
}


@pytest.mark.parametrize("question", GOLD)
def test_gold_questions(question):
    assert to_spec(question) == GOLD[question]


def test_refusals_and_asking_back():
    assert isinstance(to_spec("what is the weather"), Refused)
    assert isinstance(to_spec("by region"), Refused)
    assert isinstance(to_spec("revenue by brand"), Refused)  # an order is of many brands
    asked = to_spec("revenu by region")
    assert isinstance(asked, ClarifyNeeded) and "revenue" in asked.options
    assert isinstance(to_spec("customers by year"), Refused)
    assert isinstance(check(QuerySpec(("order_revenue",), where=(Filter("region", "=", "MARS"),))), Refused)
    two_ways = Catalog(
        CATALOG.metrics, CATALOG.dimensions, CATALOG.joins | {("orders", "nation"): ("o_x", "n_x"), ("lineitem", "customer"): ("a", "b")}
    )
    assert isinstance(check(QuerySpec(("line_revenue",), ("nation",)), two_ways), ClarifyNeeded)


def test_follow_ups_equal_the_full_question():
    talk = Conversation()
    talk.hear("revenue by region")
    assert talk.hear("only 1997") == to_spec("revenue by region in 1997")
    assert isinstance(talk.hear("what about the moon"), Refused)
    assert talk.hear("by nation") == to_spec("revenue by nation in 1997")
    assert talk.hear("in asia") == to_spec("revenue by nation in 1997 in asia")
    assert talk.hear("and in europe") == to_spec("revenue by nation in 1997 in europe")
    assert len(talk.rows()) == 6


def test_answer_carries_checks_and_provenance(spark):
    got = ask(spark, SF, "revenue by region")
    assert got.rows.count() == 5 and all(c.passed for c in got.checks)
    assert got.provenance.tables == ("orders", "customer", "nation", "region")
    assert dict(got.provenance.as_of).keys() == {"sales"} and "Join" in got.provenance.plan
    assert "parts add up" in got.verified
    assert isinstance(ask(spark, SF, "weather"), Refused)


def test_planted_faults_are_caught(spark):
    spec = QuerySpec(("order_revenue",), ("region",))
    rows, total = compile_spec(spark, SF, spec), compile_spec(spark, SF, QuerySpec(("order_revenue",)))
    assert answers.parts_and_total(rows, total, "order_revenue").passed
    assert not answers.parts_and_total(rows.where("region <> 'ASIA'"), total, "order_revenue").passed
    assert not answers.parts_and_total(rows.union(rows), total, "order_revenue").passed
    bad = Catalog(CATALOG.metrics, CATALOG.dimensions, {("orders", "customer"): ("o_custkey", "c_nationkey")})
    found = answers.not_multiplied(spark, SF, QuerySpec(("order_revenue",), ("segment",)), "order_revenue", bad)
    assert not found.passed and "c_nationkey" in found.told


def test_joins_at_their_edges(spark):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    left = spark.createDataFrame([(1, t(1)), (1, t(3)), (2, t(1)), (None, t(1))], "k long, t timestamp_ntz")
    right = spark.createDataFrame([(1, t(1), "a"), (1, t(2), "b"), (2, t(2), "c")], "k2 long, t2 timestamp_ntz, v string")
    got = joins.as_of(left, right, ("k", "k2"), ("t", "t2"), {"v": "v"}).collect()
    assert sorted((r.k or 0, r.t.hour, r.v or "-") for r in got) == [(0, 1, "-"), (1, 1, "a"), (1, 3, "b"), (2, 1, "-")]
    near = joins.interval(left, right, ("k", "k2"), ("t", "t2"), 3600, 3600)
    assert sorted((r.k, r.t.hour, r.v) for r in near.collect()) == [(1, 1, "a"), (1, 1, "b"), (1, 3, "b"), (2, 1, "c")]
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 1.0)], "g string, v double")
    b = spark.createDataFrame([("x", 1.5), ("z", 1.0)], "g string, v double")
    agreed = {r.g: r.agrees for r in joins.reconcile(a, b, ["g"], "v", 1.0).collect()}
    assert agreed == {"x": True, "y": False, "z": False, None: False}
    salted = joins.salted(a, a.withColumnRenamed("v", "w"), "g", 3)
    assert sorted(map(tuple, salted.collect())) == [("x", 1.0, 1.0), ("y", 2.0, 2.0)]
    with pytest.raises(ValueError):
        joins.salted(a, b, "g", how="full")


def test_udfs_connectors_and_table_functions(spark, tmp_path):
    register_functions(spark)
    slots = {tuple(r) for r in spark.sql("select * from explain_question('revenue by region in asia')").collect()}
    assert ("metric", "order_revenue") in slots and ("where", "region = ASIA") in slots
    assert spark.sql("select net_price(100, 0.25) as p").first().p == 75
    df = spark.range(20).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    df.createOrReplaceTempView("nums")
    assert spark.sql("select g, trimmed_mean(v) as m from nums group by g order by g").first().m == 9
    for fmt in ("parquet", "orc", "json", "csv"):
        connectors.write(df, fmt, f"{tmp_path}/{fmt}")
        assert connectors.read(spark, fmt, f"{tmp_path}/{fmt}", "g long, v double").count() == 20
    with pytest.raises(ValueError):
        connectors.read(spark, "csv", str(tmp_path))


def test_streams_late_rows_restart_and_upsert(spark, tmp_path):
    t = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    feed = f"{tmp_path}/feed"

    def arrive(rows):
        rows = [(i, ts, u, "view", 1.0, "{}") for i, ts, u in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    arrive([(1, t(1, 1), 1), (2, t(1, 1, 30), 1), (3, t(1, 2, 1), 1), (4, t(3, 1), 2)])
    events = lambda: refresh.events_stream(spark, feed)
    run = lambda name, df: refresh.drain(df, f"{tmp_path}/c-{name}", path=f"{tmp_path}/o-{name}")
    out = lambda name: spark.read.parquet(f"{tmp_path}/o-{name}")
    for _ in range(2):
        run("day", refresh.windowed(events(), "1 day"))
        run("session", refresh.sessions(events()))
        run("dedup", refresh.deduplicated(events(), ["event_id"]))
    assert [(r.start.day, r.n) for r in out("day").collect()] == [(1, 3)]
    # Exactly a gap apart is one session; a minute more is another.
    assert sorted((r.start.hour, r.n) for r in out("session").collect()) == [(1, 2), (2, 1)]
    arrive([(9, t(1, 5), 1), (4, t(3, 1), 2), (10, t(5, 1), 2)])  # late, repeated, new
    run("day", refresh.windowed(events(), "1 day"))
    run("dedup", refresh.deduplicated(events(), ["event_id"]))
    assert sorted((r.start.day, r.n) for r in out("day").collect()) == [(1, 3), (3, 2)]
    assert sorted(r.event_id for r in out("dedup").collect()) == [1, 2, 3, 4, 10]

    latest = serving.ServingTable(spark, f"{tmp_path}/latest", events().schema, ["user_id"])
    refresh.drain(events(), f"{tmp_path}/c-up", sink=serving.upserts(latest, [F.col("ts").desc()]))
    assert {r.user_id: r.event_id for r in latest.read().collect()} == {1: 9, 2: 10}

    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    refresh.drain(refresh.running(events()), f"{tmp_path}/c-run", name="running_out", mode="update")
    assert {r.user_id: r.n for r in spark.read.table("running_out").collect()} == {1: 4, 2: 3}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
