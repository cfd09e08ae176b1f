"""Streaming operators as registered queries: the stream is drained, and what it emitted is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.registering import registry
from ledgerlark.sources.catalog import load
from ledgerlark.storage import fresh_path
from ledgerlark.streaming import refresh, serving

QUERIES, ORACLES, register = registry()


def _folder(spark: SparkSession) -> str:
    return fresh_path(spark, "stream")


def _emitted(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = _folder(spark)
    refresh.drain(df, f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.events_stream(spark, f"{sf_dir}/events.parquet*")


_CLOSED = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"


@register(
    "stream_tumbling_closed_windows",
    f"""select cast(date_trunc('day', ts) as timestamptz) as start, event_type, count(*) as n, round(sum(value), 4) as total
    from events where date_trunc('day', ts) + interval 1 day <= {_CLOSED} group by 1, 2""",
)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _emitted(spark, refresh.windowed(_events(spark, sf_dir), "1 day"))
    return out.withColumn("total", F.round("total", 4))


@register(
    "stream_sliding_closed_windows",
    f"""with w as (select ts, event_type, value, date_trunc('day', ts) + interval 6 hour * k as start
      from events, (select unnest(generate_series(-3, 3)) as k))
    select cast(start as timestamptz) as start, event_type, count(*) as n, round(sum(value), 4) as total from w
    where ts >= start and ts < start + interval 1 day and start + interval 1 day <= {_CLOSED} group by 1, 2""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _emitted(spark, refresh.windowed(_events(spark, sf_dir), "1 day", "6 hours"))
    return out.withColumn("total", F.round("total", 4))


@register("stream_deduplicated", "select event_id, user_id from events")
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return _emitted(spark, refresh.deduplicated(events, ["event_id"]).select("event_id", "user_id"))


@register(
    "stream_static_join",
    """select c_mktsegment, event_id from events join customer on user_id = c_custkey where event_type = 'purchase'""",
)
def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    events = _events(spark, sf_dir).where("event_type = 'purchase'")
    return _emitted(spark, events.join(customers, F.col("user_id") == F.col("c_custkey")).select("c_mktsegment", "event_id"))


@register(
    "stream_stream_join",
    """select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = 'click'
    and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _events(spark, sf_dir).where("event_type = 'click'")
    purchases = _events(spark, sf_dir).where("event_type = 'purchase'")
    return _emitted(spark, refresh.joined_streams(clicks, purchases, "2 hours"))


@register(
    "stream_sessions_closed",
    f"""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute
    then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g),
    e as (select user_id, min(ts) as a, max(ts) + interval 30 minute as b, count(*) as n from s group by user_id, s)
    select user_id, cast(a as timestamptz) as start, cast(b as timestamptz) as "end", n from e where b <= {_CLOSED}""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emitted(spark, refresh.sessions(_events(spark, sf_dir)))


@register(
    "stream_running_state",
    "select user_id, count(*) as n, arg_max(value, (ts, event_id)) as latest from events group by 1",
)
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of one's own; of what each batch gives for a user, the state of the most events is the last."""
    folder = _folder(spark)
    own = spark.newSession()  # its setting is no other query's
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
    out = refresh.running(_events(own, sf_dir))
    refresh.drain(out, f"{folder}/checkpoint", mode="update", sink=sink)
    given = spark.read.schema(out.schema).parquet(f"{folder}/out/*")
    return given.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("latest", "n").alias("latest"))


def _served(spark: SparkSession, df: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """What a serving table holds after the stream's last batch."""
    folder = _folder(spark)
    table = serving.ServingTable(spark, f"{folder}/table", df.schema, keys, 8)
    sink = serving.replaces(table) if mode == "complete" else serving.upserts(table)
    refresh.drain(df, f"{folder}/checkpoint", mode=mode, sink=sink)
    return table.read()


@register(
    "stream_tumbling_update",
    """select cast(date_trunc('day', ts) as timestamptz) as start, event_type, count(*) as n, round(sum(value), 4) as total
    from events group by 1, 2""",
)
def tumbling_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, the open ones too: each batch gives those that changed, and the table keeps the last of each."""
    windows = refresh.windowed(_events(spark, sf_dir), "1 day")
    return _served(spark, windows, ["start", "event_type"], "update").withColumn("total", F.round("total", 4))


@register(
    "stream_running_complete",
    "select event_type, count(*) as n, round(sum(value), 4) as total, max(event_id) as latest from events group by 1",
)
def running_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running aggregate: each batch gives all groups, which take the place of the whole table."""
    groups = _events(spark, sf_dir).groupBy("event_type")
    sums = groups.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("latest"))
    return _served(spark, sums, ["event_type"], "complete").withColumn("total", F.round("total", 4))
