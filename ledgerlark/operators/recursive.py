"""Recursion over tables: a step is joined to what the last round added, until a round adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.storage import fresh_path


class NotFinished(RuntimeError):
    """The recursion still finds rows after the last round that was allowed."""


def iterate(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], rounds: int, number: str = "round") -> DataFrame:
    """All rows with a new key that seed and then step, over and over, give; number tells the round a row was found in.

    step gets what the round before added, with seed's columns, and returns rows of the same columns. A key that is
    known is dropped by an anti-join, so cycles end. Each round is stored: plans do not grow and a lost executor repeats
    one round at most. Rows with a null in the key are dropped; of several rows with one key in a round any is kept, so step should
    give equal ones. Raises NotFinished if round `rounds` still adds rows.
    """
    spark, path = seed.sparkSession, fresh_path(seed.sparkSession, "recursion")
    schema, columns = seed.schema, seed.columns
    fresh = seed.dropna(subset=key).dropDuplicates(key)
    for n in range(rounds + 1):
        fresh.write.parquet(f"{path}/{number}={n}")
        added = spark.read.schema(schema).parquet(f"{path}/{number}={n}")
        known = spark.read.schema(schema).option("basePath", path).parquet(path)
        if added.isEmpty():
            return known.select(*columns, F.col(number).cast("long").alias(number))
        fresh = step(added).select(*columns).dropna(subset=key).dropDuplicates(key).join(known.select(*key), key, "left_anti")
    if fresh.isEmpty():
        return spark.read.schema(schema).option("basePath", path).parquet(path).select(*columns, F.col(number).cast("long").alias(number))
    raise NotFinished(f"rows are still added after round {rounds}")


def reachable(seeds: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, hops): what can be reached from seeds(node) over edges(src, dst), and by how many edges at least."""
    follow = lambda last: last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
    return iterate(seeds.select("node"), follow, ["node"], rounds, "hops")
