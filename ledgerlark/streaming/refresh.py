"""Streams over the sources' change feeds: windows, sessions, deduplication, joins and state of one's own.

serving.py has the tables that streams keep current."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ledgerlark.sources.catalog import SCHEMAS

LATE = "1 hour"


def events_stream(spark: SparkSession, folder: str, late: str = LATE, files_at_once: int | None = None) -> DataFrame:
    """events as a stream; ts becomes a timestamp, as watermarks know no other type."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A new session starts after more than the gap; two events exactly a gap apart are one session."""
    counts = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, by: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(by)


def joined_streams(a: DataFrame, b: DataFrame, within: str) -> DataFrame:
    """b's events up to so long after a's of the same user."""
    left = a.select(F.col("event_id").alias("a"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    right = b.select(F.col("event_id").alias("b"), "user_id", "ts")
    near = F.expr(f"u = user_id and ts >= t and ts <= t + interval {within}")
    return left.join(right, near).select("a", "b")


class Running(StatefulProcessor):
    """Keeps each user's number of events and latest value; one row out for each user and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "n long, latest double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        n, latest = self.state.get() if self.state.exists() else (0, None)
        for part in rows:
            n += len(part)
            latest = float(part.sort_values(["ts", "event_id"])["value"].iloc[-1])
        self.state.update((n, latest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "latest": [latest]})

    def close(self) -> None:
        pass


def running(events: DataFrame) -> DataFrame:
    """Needs the RocksDB state store provider."""
    return events.groupBy("user_id").transformWithStateInPandas(
        Running(), "user_id long, n long, latest double", "Update", "None"
    )


def drain(df: DataFrame, checkpoint: str, name: str | None = None, path: str | None = None, mode: str = "append", sink: Callable | None = None) -> StreamingQuery:
    """Runs a stream over all there is and stops: into memory by name, files by path, or a sink for each batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink:
        query = writer.foreachBatch(sink).start()
    elif path:
        query = writer.format("parquet").start(path)
    else:
        query = writer.format("memory").queryName(name).start()
    query.awaitTermination()
    return query
