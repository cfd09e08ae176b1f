"""Operator 6, best-fit packing of token sequences into bins of several permitted lengths.

A document of n words is one item of n tokens, or, if longer than the largest permitted length, a run of full
chunks and a rest. Equal rows are folded to one with a count, by partial sums, and numbered when they are unfolded, in
blocks. Items are dealt by hash, the number of the copy included, into packing groups of about GROUP_ITEMS items, each packed by itself,
so a group fits a task at any size of the input and whatever repeats; the items of a group are lengths and identifiers, never texts.

Inside a group items are placed longest first into the open bin with the least room that still fits (best fit).
If none fits, a bin is opened at the size of least cost: for each permitted length the cost of a full bin (its length
plus OVERHEAD for the sequence) is set against the tokens that it can be expected to hold, which are the item's
and as many of the yet unplaced tokens as fit behind it. So while much is left large bins are cheapest, and at the
end small ones are. At last each bin is cut down to the smallest permitted length that holds its contents.

Edge cases: null or empty text is an item of 0 tokens, which goes into a bin like any other; null doc_id is kept;
repeated rows are packed once each and told apart by `copy`; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.shared import cut, table, word_count

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP_ITEMS = 20_000

SCHEMA = (
    "doc_id long, copy int, chunk int, start long, tokens int, bin string, position int, offset int, capacity int, used int"
)


def cheapest(item: int, unplaced: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted length of least cost per token that it can be expected to hold."""
    fitting = [c for c in capacities if c >= item]
    return min(fitting, key=lambda c: ((c + overhead) / max(1, item + min(unplaced, c - item)), c))


def best_fit(
    lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each item, and the final capacity of each bin. No item may exceed the largest one."""
    capacities = tuple(sorted(capacities))
    order = np.argsort(-lengths, kind="stable")
    unplaced = int(lengths.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []  # sorted distinct rooms of open bins
    open_with: dict[int, list[int]] = {}
    size: list[int] = []
    used: list[int] = []
    for i in order.tolist():
        item = int(lengths[i])
        unplaced -= item
        at = bisect_left(room, item)
        if at < len(room):
            left = room[at]
            b = open_with[left].pop()
            if not open_with[left]:
                del open_with[left], room[at]
        else:
            b = len(size)
            left = cheapest(item, unplaced, capacities, overhead)
            size.append(left)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += item
        left -= item
        if left not in open_with:
            insort(room, left)
            open_with[left] = []
        open_with[left].append(b)
    fits = np.searchsorted(capacities, np.array(used, np.int64))
    return bins, offsets, np.array(capacities)[fits] if len(used) else np.zeros(0, np.int64)


def pack(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """One row for each item of docs(doc_id, text): where it lies in its document, in what bin and where in there."""
    largest = max(capacities)
    sized = docs.select("doc_id", word_count(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("key"))
    folded = cut(sized.groupBy("doc_id", "key", "n").agg(F.count("*").alias("copies")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / largest))
    total = folded.agg(F.sum(F.col("copies") * parts)).first()[0] or 0
    groups = max(1, -(-total // group_items))
    # Blocks of copies first, so that a row with very many is unfolded by many tasks.
    last = F.floor((F.col("copies") - 1) / group_items)
    blocks = folded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if folded.where(F.col("copies") > group_items).limit(1).count():
        blocks = blocks.repartition("key", "block")
    first = F.col("block") * group_items
    unfolded = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + group_items) - 1))).withColumn("copy", F.col("copy").cast("int"))
    chunks = unfolded.withColumn("chunk", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    items = chunks.select(
        "doc_id",
        "key",
        "copy",
        "chunk",
        (F.col("chunk").cast("long") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("chunk").cast("long") * largest).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("key", "copy", "chunk", F.lit(6)), F.lit(groups)).cast("int").alias("group"),
    )

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "key", "copy", "chunk"], kind="stable").reset_index(drop=True)
        bins, offsets, final = best_fit(pdf["tokens"].to_numpy(np.int64), capacities, overhead)
        pdf["bin"] = [f"{key[0]}-{b}" for b in bins]
        pdf["offset"], pdf["capacity"] = offsets, final[bins]
        by_bin = pdf.sort_values("offset", kind="stable").groupby("bin", sort=False)
        pdf["position"] = by_bin.cumcount()
        pdf["used"] = pdf.groupby("bin")["tokens"].transform("sum")
        return pdf[["doc_id", "copy", "chunk", "start", "tokens", "bin", "position", "offset", "capacity", "used"]]

    return items.groupBy("group").applyInPandas(of_group, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
