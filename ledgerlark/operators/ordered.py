"""Ranks, running sums and inequality joins over one long order, without a task that holds a partition value whole.

Rows are dealt into ranges of the whole order by sampled cut points (repartitionByRange) and stored, so that every later
step sees the same ranges. A range knows its own ranks; what came before it is the sum of a few numbers of each earlier
range of the same partition value, a window over a table with a row for each (range, partition value). A partition value
with all rows spreads over all ranges, and the window inside a range never sees more than that.

Rows that are equal in all of the order stay in one range, so an order should end in something unique; peers (rows equal in the
leading columns that rank() looks at) may lie in many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.storage import stored

#: Columns of the operators themselves begin like this.
MARK = "_o_"
#: About as many rows are dealt into a range, so that a longer order has more ranges and no larger ones.
RANGE_ROWS = 200_000


def _ranged(df: DataFrame, partition: list[str], order: list[Column], ranges: int | None) -> DataFrame:
    """df with the number of each row's range. partition and order are dealt as they sort."""
    keys = [F.col(c) for c in partition] + order
    dealt = df.repartitionByRange(ranges or 1 + df.count() // RANGE_ROWS, *keys)
    return stored(dealt.withColumn(f"{MARK}range", F.spark_partition_id()), "ranges")


def _before(totals: DataFrame, partition: list[str], columns: list[str]) -> DataFrame:
    """totals with the sums of columns over earlier ranges of the same partition value, as columns named before_*."""
    w = Window.partitionBy(*partition).orderBy(f"{MARK}range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in columns))


def _joined(rows: DataFrame, told: DataFrame, partition: list[str]) -> DataFrame:
    """rows with what is told of their range and partition value; null partition values are values."""
    named = told.select(*(F.col(c).alias(f"{MARK}p{i}") for i, c in enumerate([f"{MARK}range", *partition])), *(c for c in told.columns if c not in (f"{MARK}range", *partition)))
    on = F.lit(True)
    for i, c in enumerate([f"{MARK}range", *partition]):
        on = on & (F.col(c).eqNullSafe(F.col(f"{MARK}p{i}")) if i else F.col(c) == F.col(f"{MARK}p{i}"))
    return rows.join(named, on).drop(*(f"{MARK}p{i}" for i in range(len(partition) + 1)))


def ranked(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    peers: int | None = None,
    tiles: int | None = None,
    ranges: int | None = None,
    shares_of_order: bool = False,
) -> DataFrame:
    """df with row_number, rank, dense_rank, percent_rank, cume_dist and, for tiles, ntile, by ascending order, null first.

    rank, dense_rank, percent_rank and cume_dist take rows that are equal in the first `peers` columns of the order (all of
    it by default) as ties; row_number and ntile follow the whole order, and so do percent_rank and cume_dist with
    shares_of_order. An empty table stays empty.
    """
    top = order[: peers or len(order)]
    peer = F.struct(*top)
    rows = _ranged(df, partition, [F.col(c) for c in order], ranges).withColumn(f"{MARK}peer", peer)
    here = [f"{MARK}range", *partition]
    by_order = Window.partitionBy(*here).orderBy(*order)
    by_peer = Window.partitionBy(*here).orderBy(*top)
    own = rows.select(
        "*",
        F.row_number().over(by_order).cast("long").alias(f"{MARK}rn"),
        F.rank().over(by_peer).cast("long").alias(f"{MARK}rank"),
        F.dense_rank().over(by_peer).cast("long").alias(f"{MARK}dense"),
        F.count("*").over(by_peer).alias(f"{MARK}upto"),
        *([F.rank().over(by_order).alias(f"{MARK}order_rank"), F.count("*").over(by_order).alias(f"{MARK}order_upto")] if shares_of_order else []),
    )
    totals = own.groupBy(*here).agg(
        F.count("*").alias("n"),
        F.max(f"{MARK}dense").alias("kinds"),
        F.min(f"{MARK}peer").alias("first"),
        F.max(f"{MARK}peer").alias("last"),
        F.max(f"{MARK}rank").alias("last_rank"),
        F.min(f"{MARK}upto").alias("first_upto"),
    )
    at = Window.partitionBy(*partition).orderBy(f"{MARK}range")
    # Whether a range goes on with the last peers of the one before, which are then counted once.
    goes_on = F.coalesce(F.col("first") == F.lag("last").over(at), F.lit(False)).cast("long")
    sums = _before(totals.withColumn("new", F.col("kinds") - goes_on), partition, ["n", "new"]).withColumn("goes_on", goes_on)
    all_n = F.sum("n").over(Window.partitionBy(*partition))
    # Peers at the ends of ranges begin and end where the first and last of their ranges say.
    begin, end = F.col("before_n") + 1, F.col("before_n") + F.col("n")
    ends = sums.select(*partition, F.col("first").alias("peer"), begin.alias("from"), (F.col("before_n") + F.col("first_upto")).alias("to")).unionByName(
        sums.select(*partition, F.col("last").alias("peer"), (F.col("before_n") + F.col("last_rank")).alias("from"), end.alias("to"))
    )
    spans = ends.groupBy(*partition, "peer").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    told = sums.withColumn("all_n", all_n)
    for side in ("first", "last"):
        named = spans.select(*(F.col(c).alias(f"{MARK}{side}{i}") for i, c in enumerate([*partition, "peer"])), F.col("from").alias(f"{side}_from"), F.col("to").alias(f"{side}_to"))
        on = F.col(side).eqNullSafe(F.col(f"{MARK}{side}{len(partition)}"))
        for i, c in enumerate(partition):
            on = on & F.col(c).eqNullSafe(F.col(f"{MARK}{side}{i}"))
        told = told.join(named, on).drop(*(f"{MARK}{side}{i}" for i in range(len(partition) + 1)))
    both = _joined(own, told, partition)
    is_first, is_last = F.col(f"{MARK}dense") == 1, F.col(f"{MARK}dense") == F.col("kinds")
    n = F.col("all_n")
    number = F.col("before_n") + F.col(f"{MARK}rn")
    rank = F.when(is_first, F.col("first_from")).otherwise(F.col("before_n") + F.col(f"{MARK}rank"))
    upto = F.when(is_last, F.col("last_to")).when(is_first, F.col("first_to")).otherwise(F.col("before_n") + F.col(f"{MARK}upto"))
    # Rows that are equal in the whole order lie in one range.
    share_rank = F.col("before_n") + F.col(f"{MARK}order_rank") if shares_of_order else rank
    share_upto = F.col("before_n") + F.col(f"{MARK}order_upto") if shares_of_order else upto
    found = {
        "row_number": number,
        "rank": rank,
        "dense_rank": F.col("before_new") - F.col("goes_on") + F.col(f"{MARK}dense"),
        "percent_rank": F.when(n > 1, (share_rank - 1) / (n - 1)).otherwise(F.lit(0.0)),
        "cume_dist": share_upto / n,
    }
    if tiles:
        size, over = F.floor(n / tiles), n % tiles
        large = over * (size + 1)
        found["ntile"] = F.when(number <= large, F.floor((number - 1) / (size + 1))).otherwise(over + F.floor((number - 1 - large) / size)) + 1
    return both.select(*df.columns, *(c.alias(k) for k, c in found.items()))


def inequality_join(left: DataFrame, right: DataFrame, on: tuple[str, str], op: str, take: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """left with aggregates over all right rows whose value is `op` left's: <, <=, > or >=, with no equality key.

    take maps new names to sums over right rows, as columns of right: {"n": F.lit(1), "total": F.col("amount")}; a row
    without partners gets 0. Both sides are stacked and put in one order, where the rows that a left row asks for are
    those before it, so no pairs are made. Equal values on both sides may lie in many ranges: their order is told by side first,
    then by a hash of the row. Null values have no partners. The sums have the type of sum() over the column.
    """
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"no inequality: {op}")
    descending = op.startswith(">")
    rows = F.struct(*(left[c] for c in left.columns))
    a = left.select(F.col(on[0]).alias("v"), rows.alias("row"), F.xxhash64(*left.columns).alias("salt"))
    values = right.where(F.col(on[1]).isNotNull()).select(F.col(on[1]).alias("v"), *(c.alias(f"{MARK}{k}") for k, c in take.items()))
    b = values.withColumn("salt", F.xxhash64(*values.columns))
    # With "=" right rows of an equal value come first, else last.
    ours, theirs = (1, 0) if op.endswith("=") else (0, 1)
    both = a.withColumn("side", F.lit(ours)).unionByName(b.withColumn("side", F.lit(theirs)), allowMissingColumns=True)
    order = [F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first(), F.col("side"), F.col("salt")]
    ranged = _ranged(both, [], order, ranges)
    names = [f"{MARK}{k}" for k in take]
    sums = ranged.groupBy(f"{MARK}range").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    told = _before(sums, [], names).drop(*names)  # a row for each range
    up_to = Window.partitionBy(f"{MARK}range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = ranged.select("*", *(F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{MARK}upto_{c}") for c in names))
    found = _joined(here.where(F.col("side") == ours).drop(*names), told, [])
    value = lambda c: F.when(F.col("v").isNotNull(), F.col(f"before_{c}") + F.col(f"{MARK}upto_{c}")).otherwise(F.lit(0))
    return found.select("row.*", *(value(f"{MARK}{k}").cast(ranged.agg(F.sum(f"{MARK}{k}").alias("x")).schema["x"].dataType).alias(k) for k in take))
