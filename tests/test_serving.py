"""Serving tables under crashes and repeated batches; recursion over tables."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators import recursive
from ledgerlark.streaming import refresh, serving

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, path, buckets=4):
    return serving.ServingTable(spark, f"{path}/t", SCHEMA, ["k"], buckets)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    t, df = table(spark, tmp_path), lambda x: spark.createDataFrame(x, SCHEMA)
    assert t.read().count() == 0 and t.vacuum() == []
    t.upsert(df([(1, "a"), (2, "b"), (None, "n")]), 0)
    t.upsert(df([(1, "c"), (None, "m"), (5, "x"), (5, "y")]), 1, [F.col("v").desc()])
    t.upsert(df([]), 2)
    assert rows(t.read()) == rows(df([(1, "c"), (2, "b"), (None, "m"), (5, "y")]))
    assert rows(t.read(version=0)) == rows(df([(1, "a"), (2, "b"), (None, "n")]))
    t.upsert(df([(1, "never")]), 1)  # a batch that was finished comes again
    assert rows(t.read()) == rows(df([(1, "c"), (2, "b"), (None, "m"), (5, "y")]))


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, 16)
    t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), 0)
    t.upsert(spark.createDataFrame([(7, "b")], SCHEMA), 1)
    assert len(list(Path(f"{tmp_path}/t/data/version=1").glob("bucket=*"))) == 1
    assert t.read().count() == 200 and t.read().where("v = 'b'").count() == 1
    assert t.vacuum() == []  # version 0 still has the other buckets
    t.replace(spark.createDataFrame([(1, "only")], SCHEMA), 2)
    assert rows(t.read()) == [(1, "only")]
    assert t.vacuum() == [0, 1] and rows(t.read()) == [(1, "only")]
    t.replace(spark.createDataFrame([], SCHEMA), 3)
    assert rows(t.read()) == []


def test_a_crash_before_the_pointer_moves_loses_nothing(spark, tmp_path, monkeypatch):
    t, df = table(spark, tmp_path), lambda x: spark.createDataFrame(x, SCHEMA)
    t.upsert(df([(1, "a"), (2, "b")]), 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(serving.ServingTable, "_point", crash)
        for change in (lambda: t.upsert(df([(1, "half"), (3, "c")]), 1), lambda: t.replace(df([(9, "half")]), 1)):
            with pytest.raises(OSError):
                change()
            assert rows(t.read()) == [(1, "a"), (2, "b")]
    t.upsert(df([(1, "whole"), (3, "c")]), 1)
    assert rows(t.read()) == [(1, "whole"), (2, "b"), (3, "c")]


def test_update_mode_over_many_batches_equals_the_batch(spark, tmp_path, monkeypatch):
    """With a crash after a batch's data were written: the stream starts again from its checkpoint."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=3 * i)
    for part in range(4):
        events = [(i, day(i), i % 3, "view" if i % 2 else "click", 1.0, "{}") for i in range(40) if i % 4 == part]
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    windows = lambda: refresh.windowed(refresh.events_stream(spark, f"{tmp_path}/feed", "9 days", 1), "1 day")
    t = serving.ServingTable(spark, f"{tmp_path}/t", windows().schema, ["start", "event_type"], 4)
    calls, point = [], serving.ServingTable._point

    def crash_once(self, number, at):
        calls.append(number)
        if len(calls) == 3:
            raise OSError("lost")
        point(self, number, at)

    monkeypatch.setattr(serving.ServingTable, "_point", crash_once)
    with pytest.raises(Exception, match="lost"):
        refresh.drain(windows(), f"{tmp_path}/c", mode="update", sink=serving.upserts(t))
    assert t.manifest()[0] == 1
    refresh.drain(windows(), f"{tmp_path}/c", mode="update", sink=serving.upserts(t))
    batch = spark.read.parquet(f"{tmp_path}/feed").withColumn("ts", F.col("ts").cast("timestamp"))
    assert calls[:5] == [0, 1, 2, 2, 3] and rows(t.read()) == rows(refresh.windowed(batch, "1 day"))


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9), (None, 1), (4, None)], "src long, dst long")
    seed = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert rows(recursive.reachable(seed(1, 1), edges)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(recursive.reachable(seed(9), edges)) == [(9, 0)]
    assert rows(recursive.reachable(seed(None), edges)) == []
    assert rows(recursive.reachable(seed(1), edges, rounds=3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(recursive.NotFinished):
        recursive.reachable(seed(1), edges, rounds=2)
