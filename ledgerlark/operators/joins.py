"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: As-of joins: histories of up to so many rows a key are held as lists; of more rows, a bucket of time has about this many.
MOST_HISTORY = 64
BUCKET_ROWS = 500_000


def as_of(
    left: DataFrame,
    right: DataFrame,
    key: tuple[str, str],
    time: tuple[str, str],
    take: dict[str, str],
    history: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """left with the latest right row at or before its time, by key; take maps right columns to new names.

    A right row at exactly left's time counts; of several at one time the greatest taken values do. Null keys and times
    have no partner. history is the most right rows that a key has; it is counted where it isn't given, and decides the
    form: short histories are lists that are looked up (_by_list), long ones go by buckets of time (_by_buckets), so that
    a key with very many rows spans many tasks.
    """
    told = F.struct(*(F.col(c).alias(n) for c, n in take.items()))
    there = F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull()
    b = right.where(there).select(F.col(key[1]).alias("k"), F.col(time[1]).alias("t"), told.alias("told"))
    if history is None:
        history = b.groupBy("k").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    rows = F.struct(*(left[c] for c in left.columns))
    a = left.select(F.col(key[0]).alias("k"), F.col(time[0]).alias("t"), rows.alias("row"))
    found = _by_list(a, b) if history <= MOST_HISTORY else _by_buckets(a, b, -(-history // bucket_rows))
    return found.select("row.*", *(F.col("last")[n].alias(n) for n in take.values()))


def _by_list(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each key's history as one list, joined once; no pairs are made."""
    lists = b.groupBy(F.col("k").alias("k2")).agg(F.collect_list(F.struct("t", "told")).alias("history"))
    past = F.filter("history", lambda x: x["t"] <= F.col("t"))
    return a.join(lists, F.col("k") == F.col("k2"), "left").select("row", F.array_max(past)["told"].alias("last"))


def _by_buckets(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """Both sides in one order, key by key and bucket by bucket of time; what a bucket begins with is carried to it.

    The last right row of each (key, bucket) is found first, by partial sums. A window over these few rows tells each
    bucket what came before it; that row then stands at the bucket's beginning, so buckets are worked on by themselves.
    """
    span = b.agg(F.min(_micros("t")).alias("low"), F.max(_micros("t")).alias("high")).first()
    width = max(1, -(-(span["high"] - span["low"] + 1) // buckets))
    bucket = F.greatest(F.lit(-1), F.least(F.lit(buckets), F.floor((_micros("t") - F.lit(span["low"])) / F.lit(width)))).cast("long")
    a, b = a.withColumn("bucket", bucket), b.withColumn("bucket", bucket)
    ends = b.groupBy("k", "bucket").agg(F.max(F.struct("t", "told")).alias("end"))
    asked = a.where("k is not null and t is not null").select("k", "bucket", F.lit(None).cast(ends.schema["end"].dataType).alias("end"))
    each = ends.unionByName(asked.distinct()).groupBy("k", "bucket").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("told", F.last("end", ignorenulls=True).over(earlier)["told"]).where("told is not null")
    begins = carried.select("k", "bucket", "told", F.lit(-1).alias("side"))
    both = begins.unionByName(b.withColumn("side", F.lit(0)), allowMissingColumns=True)
    both = both.unionByName(a.withColumn("side", F.lit(1)), allowMissingColumns=True)
    # A bucket's first row has no time of its own, and null comes first. A null key has none but left rows: they spread.
    salt = F.when(F.col("k").isNull() | ((F.col("side") == 1) & F.col("t").isNull()), F.xxhash64("row"))
    order = Window.partitionBy("k", "bucket", salt).orderBy("t", "side", "told").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("told", ignorenulls=True).over(order)).where("side = 1").select("row", "last")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def interval(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], before: int, after: int) -> DataFrame:
    """Pairs of equal key whose times differ by -before to +after seconds (right minus left).

    Times fall into buckets as wide as the interval, so a key's rows meet only those near them and a key with very many
    rows is spread over many tasks.
    """
    width = max(1, before + after)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = left.withColumn("_s", seconds(time[0])).withColumn(
        "_b", F.explode(F.sequence(F.floor((F.col("_s") - before) / width), F.floor((F.col("_s") + after) / width)))
    )
    b = right.withColumn("_s2", seconds(time[1])).withColumn("_b2", F.floor(F.col("_s2") / width))
    exact = (F.col(time[1]) >= F.col(time[0]) - F.make_dt_interval(secs=F.lit(before))) & (
        F.col(time[1]) <= F.col(time[0]) + F.make_dt_interval(secs=F.lit(after))
    )
    met = a.join(b, (F.col(key[0]) == F.col(key[1])) & (F.col("_b") == F.col("_b2")) & exact)
    return met.drop("_s", "_b", "_s2", "_b2")


def salted(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose left keys are dealt over so many tasks each, for joins that AQE can't split."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep or drop left rows can be salted on the left")
    return a.join(b, [on, "_salt"], how).drop("_salt")


def collate(parts: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Aggregates of several sources side by side: full outer join on their common grain."""
    out = None
    for name, df in parts.items():
        side = df.select(*on, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in on))
        out = side if out is None else out.join(side, on, "full")
    return out


def reconcile(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """Both sides' value by grain, their gap, and whether they agree; a missing side does not."""
    both = collate({"a": a, "b": b}, on)
    gap = F.abs(F.col(f"a_{value}") - F.col(f"b_{value}"))
    return both.withColumn("gap", gap).withColumn("agrees", F.coalesce(gap <= F.lit(tolerance), F.lit(False)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; order needs a unique tie-breaker to be the same on each run."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
