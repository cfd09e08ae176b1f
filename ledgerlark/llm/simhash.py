"""Operator 1, SimHash near-duplicates linked through pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Fingerprints are linked
at RADIUS or fewer differing bits. Copies of a fingerprint are folded into one class before anything is compared.

Candidates come from Hamming distances to reference fingerprints (pivots). The coarse pivots are the zero
fingerprint and the 16 fingerprints that have one nibble set. As the distance moves by at most one for each
differing bit, two fingerprints within two bits have a midpoint whose row of the distance table is at most one
step from both. So each fingerprint is filed under its own row of the table and under the rows one step away
(33 cells at most), and linked fingerprints always share a cell. In a cell, pairs whose coordinates differ by more
than the radius in any of the pivots are discarded and the survivors are verified bit by bit.

A cell with more than PAIRS fingerprints is never expanded into pairs: its members are filed again by the fine
pivots, the 64 fingerprints of one bit. Their distances determine the midpoint itself, hence all that share such
a cell are within two bits of each other, and a link to the cell's smallest member keeps every component whole.

Edge cases: null text counts as a text without words; a text without words has fingerprint zero, and all such
texts are linked like any other; a text of fewer words than a shingle is one shingle; null doc_id rows are kept, link
others, and take the component of their class (null if no row of the component has a doc_id); repeated rows come out repeated; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.shared import cut, table

RADIUS = 2
#: Cells with more members than this go to the fine pivots.
PAIRS = 24


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the lower-cased text, repeats included."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64
    )


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number: each bit that over half the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): one row for each row of docs."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([majority(shingle_hashes(x, words)) for x in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def pivot_row(fp: Column) -> Column:
    """Distances to the coarse pivots, packed: four bits for each nibble pivot.

    With d0 the distance to zero and di that to nibble pivot i, nibble i of the result is (d0 + 4 - di) / 2.
    """
    # Half-adders for the pairs of bits, as a plain addition would overflow in the top pair.
    low = fp.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    pairs = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(
        F.lit(0x3333333333333333)
    )


def coarse_cells(row: Column) -> Column:
    """A row of the distance table and the rows one step away."""
    steps = [row]
    for i in range(16):
        digit = F.shiftrightunsigned(row, 4 * i).bitwiseAND(F.lit(15).cast("long"))
        for change, allowed in ((1, digit < 4), (-1, digit > 0)):
            moved = F.shiftleft(digit.bitwiseXOR(digit + F.lit(change).cast("long")), 4 * i)
            steps.append(F.when(allowed, row.bitwiseXOR(moved)))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def coordinate_gap(a: Column, b: Column) -> Column:
    """The largest difference between two rows of the distance table."""
    nibble = lambda x, i: F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15).cast("long"))
    return F.greatest(*(F.abs(nibble(a, i) - nibble(b, i)) for i in range(16)))


def spread(classes: DataFrame, key: str) -> DataFrame:
    """classes dealt out again: each is about to become many rows, and small partitions were put together."""
    return classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def links(classes: DataFrame) -> DataFrame:
    """(a, b): edges between the nodes of classes(fp, node) whose components are those of the link graph."""
    row = pivot_row(F.col("fp"))
    cells = classes.select("fp", "node", row.alias("row"))
    filed = cells.select("fp", "node", "row", F.explode(coarse_cells(F.col("row"))).alias("cell"))
    sizes = filed.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(filed.join(sizes, "cell").select("cell", "members", "fp", "node", "row"))

    x = shared.where(F.col("members") <= PAIRS)
    y = x.select("cell", F.col("fp").alias("fp2"), F.col("node").alias("b"), F.col("row").alias("row2"))
    near = (
        x.select("cell", "fp", F.col("node").alias("a"), "row")
        .join(y, "cell")
        .where(F.col("fp") < F.col("fp2"))
        .where(coordinate_gap(F.col("row"), F.col("row2")) <= RADIUS)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
        .select("a", "b")
    )
    crowded = shared.where(F.col("members") > PAIRS).select("fp", "node").distinct()
    one_bit = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    fine = crowded.select("fp", "node", F.explode(one_bit).alias("pivot")).select(
        F.col("fp").bitwiseXOR(F.col("pivot")).alias("cell"), "node"
    )
    hubs = fine.groupBy("cell").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1")
    return near.union(fine.join(hubs, "cell").where("node <> a").select("a", F.col("node").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links, the document's own included.
    """
    prints = cut(fingerprints(docs, words))
    # A class is known by its fingerprint, so rows without doc_id link others like any row.
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    known = connected_components(links(spread(classes, "fp").select("fp", F.col("fp").alias("node"))))
    of_class = cut(classes.join(known, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of_class.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3)
