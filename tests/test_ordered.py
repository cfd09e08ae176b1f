"""Long orders, as-of joins by both forms, inequality joins: against loops over all rows."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.catalog_queries import QUERIES
from ledgerlark.operators import joins, ordered


def tasks_with_rows(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().count()


@pytest.mark.parametrize("ties", [1, 3, 40])
def test_ranks_equal_windows(spark, ties):
    rng = random.Random(ties)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(120 // ties)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(5)
    got = ordered.ranked(df, ["g"], ["x", "id"], peers=1, tiles=7, ranges=9)
    full, top = Window.partitionBy("g").orderBy("x", "id"), Window.partitionBy("g").orderBy("x")
    want = df.select(
        "*",
        F.row_number().over(full).cast("long"),
        F.rank().over(top).cast("long"),
        F.dense_rank().over(top).cast("long"),
        F.percent_rank().over(top),
        F.cume_dist().over(top),
        F.ntile(7).over(full).cast("long"),
    )
    key = lambda r: r[2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_one_partition_value_uses_many_tasks(spark):
    df = spark.range(4000).select(F.lit("all").alias("g"), F.lit(1).alias("x"), "id")
    dealt = ordered._ranged(df, ["g"], [F.col("x"), F.col("id")], 8)
    sizes = [r["count"] for r in dealt.groupBy("_o_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    got = ordered.ranked(df, ["g"], ["x", "id"], peers=1, ranges=8)
    assert got.agg(F.max("row_number"), F.max("rank"), F.max("dense_rank"), F.min("cume_dist")).first() == (4000, 1, 1, 1.0)
    assert ordered.ranked(df.limit(0), ["g"], ["id"]).count() == 0


def test_shares_of_the_whole_order(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), rng.randrange(60)) for _ in range(400)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(5)
    got = ordered.ranked(df, ["g"], ["x", "y"], peers=1, ranges=9, shares_of_order=True)
    full, top = Window.partitionBy("g").orderBy("x", "y"), Window.partitionBy("g").orderBy("x")
    want = df.select("*", F.rank().over(top).cast("long"), F.percent_rank().over(full), F.cume_dist().over(full))
    kept = got.select("g", "x", "y", "rank", "percent_rank", "cume_dist")
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_longer_orders_have_more_ranges_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    for n in (1000, 4000):
        df = spark.range(n).select(F.lit("all").alias("g"), "id")
        sizes = [r["count"] for r in ordered._ranged(df, ["g"], [F.col("id")], None).groupBy("_o_range").count().collect()]
        assert len(sizes) > n // 120 and max(sizes) < 300


def test_ranks_of_few_statuses_use_many_tasks(spark, monkeypatch):
    """Three statuses: the tasks that number orders are far more than three, and none has a window over a whole status."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    plan = QUERIES["ranks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    over = re.findall(r"row_number\(\) windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert over and all("_o_range" in w for w in over), over


def test_peers_of_few_types_are_counted_before_the_window(spark):
    plan = QUERIES["default_frame_with_peers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [") :]
    assert below.index("Aggregate [") < below.index("Relation ["), plan


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_inequality_join(spark, op):
    rng = random.Random(7)
    value = lambda: rng.choice([None, *range(12), 5, 5, 5])
    left, right = [(i, value()) for i in range(60)] + [(1, 5)] * 3, [(value(), rng.choice([None, 1, 2])) for _ in range(300)]
    a, b = spark.createDataFrame(left, "id long, x int"), spark.createDataFrame(right, "y int, w long")
    got = ordered.inequality_join(a, b, ("x", "y"), op, {"n": F.lit(1), "total": F.col("w")}, ranges=6)
    less = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}[op]
    want = []
    for i, x in left:
        hit = [w for y, w in right if x is not None and y is not None and less(y, x)]
        want.append((i, x, len(hit), sum(w or 0 for w in hit)))
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_as_of_forms_agree_with_a_loop(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([None, *(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(400)) for _ in range(9))])
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    left, right = [(i, key(), at()) for i in range(200)], [(key(), at(), rng.randrange(1000)) for _ in range(150)]
    a = spark.createDataFrame(left, "id long, k long, t timestamp_ntz")
    b = spark.createDataFrame(right, "k2 long, t2 timestamp_ntz, v long")
    want = []
    for i, k, t in left:
        past = [(t2, v) for k2, t2, v in right if None not in (k, t, k2, t2) and k2 == k and t2 <= t]
        want.append((i, k, t, max(past)[1] if past else None))
    for options in ({"history": 1}, {"history": 10_000, "bucket_rows": 100}, {"history": 65, "bucket_rows": 10**6}, {}):
        got = joins.as_of(a, b, ("k", "k2"), ("t", "t2"), {"v": "value"}, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want), options


def test_as_of_of_one_key_uses_many_tasks(spark):
    second = lambda c: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=c)).cast("timestamp_ntz")
    a = spark.range(3000).select(F.lit(1).alias("k"), second(F.col("id")).alias("t"), "id")
    b = spark.range(0, 3000, 3).select(F.lit(1).alias("k2"), second(F.col("id")).alias("t2"), F.col("id").alias("v"))
    got = joins.as_of(a, b, ("k", "k2"), ("t", "t2"), {"v": "v"}, bucket_rows=50)
    assert got.where("v <> id - id % 3 or v is null").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks_with_rows(joins.as_of(a, b, ("k", "k2"), ("t", "t2"), {"v": "v"}, bucket_rows=50)) >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert joins.as_of(a, b.limit(0), ("k", "k2"), ("t", "t2"), {"v": "v"}).where("v is null").count() == 3000
