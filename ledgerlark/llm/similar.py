"""Near-duplicate groups at a Jaccard similarity of word shingles, for the pipeline's SimHash stage.

At a similarity of 0.8 SimHash fingerprints of 64 bits lie about ten bits apart, where no index over Hamming
distances is selective. So fingerprints within RADIUS bits, found by the pivot tables of operator 1, are only one
source of candidates; the other is agreement in a band of min-hashes (BANDS of ROWS values: a pair at 0.8 is missed
once in 30,000). Every candidate is verified by the exact similarity of the two sets of shingles.

Texts with equal sets are one class from the start. In a band's bucket of at most PAIRS classes all pairs are
candidates. A larger one is a group of near copies too many for pairs: there each class is compared with its anchors,
which are the class of the most documents (the text that was copied, if it was copied as it is) and ANCHORS members
drawn by hash. That joins nearly all of such a group. What it leaves apart is settled exactly: where a large bucket
still holds several components, each class outside its largest one is a candidate with every class of another
component of that bucket that it can be similar to. Of those, pairs are left out by proof only: by the sizes of their
sets, and by the distances to the first anchor, which can differ by no more than the pair's own distance (Jaccard
distance is a metric). So no bucket's size costs a link.

Edge cases: null text has no words, and all texts without words are one group; repeated rows are a group of
themselves; null doc_id sorts first; an empty table gives no rows; the columns of docs are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.shared import cut
from ledgerlark.llm.simhash import links, majority, shingle_hashes, spread

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
PAIRS = 40
ANCHORS = 6
#: As many keys as are broadcast at most.
FEW = 200_000


def band_keys(distinct: np.ndarray) -> list[int]:
    """One signed number for each band of min-hashes of a set of hashes."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64)
    if not len(distinct):
        return []
    mixed = distinct ^ distinct >> np.uint64(31)
    least = np.array([(mixed * f + s).min() for f, s in zip(factors, shifts, strict=True)], np.uint64)
    return [
        xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)
    ]


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, fp, set_key, n, bands) for every row of docs(doc_id, text)."""

    @F.pandas_udf("fp long, set_key long, n int, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                hashes = shingle_hashes(text, words)
                distinct = np.unique(hashes)
                set_key = xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63)
                rows.append((majority(hashes), set_key, len(distinct), band_keys(distinct)))
            yield pd.DataFrame(rows, columns=["fp", "set_key", "n", "bands"])

    row_key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", row_key.alias("row_key"), of("text").alias("d")).select("doc_id", "row_key", "d.*")


def may_reach(n: str, other: str, similarity: float) -> Column:
    """Whether sets of such sizes can be so similar."""
    return F.least(n, other) >= F.lit(similarity) * F.greatest(n, other)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucket_members(classes: DataFrame) -> DataFrame:
    """(band, key, m, n, copies, members): the classes of every bucket that has two or more."""
    filed = spread(classes, "set_key").select(
        F.col("set_key").alias("m"), "n", "copies", F.posexplode("bands").alias("band", "key")
    )
    buckets = cut(filed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1"))
    return cut(filed.join(buckets, ["band", "key"]))


def anchors_of(large: DataFrame) -> DataFrame:
    """(band, key, anchors): the class of the most documents and ANCHORS drawn ones of each bucket."""
    drawn = [F.min(F.struct(F.xxhash64("m", F.lit(i)), "m"))["m"] for i in range(ANCHORS)]
    return cut(
        large.groupBy("band", "key").agg(F.array(F.max(F.struct("copies", "m"))["m"], *drawn).alias("anchors"))
    )


def candidates(classes: DataFrame, members: DataFrame, anchors: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of classes(set_key, fp, n, bands, copies) to be verified first."""
    by_print = classes.groupBy("fp").agg(F.min("set_key").alias("node"))
    close = links(spread(by_print, "fp"))
    same = classes.join(by_print, "fp").where("set_key <> node").select(F.col("node").alias("a"), F.col("set_key").alias("b"))
    small = members.where(F.col("members") <= PAIRS)
    pairs = (
        small.select("band", "key", F.col("m").alias("a"), "n")
        .join(small.select("band", "key", F.col("m").alias("b"), F.col("n").alias("n_b")), ["band", "key"])
        .where(F.col("a") < F.col("b"))
        .where(may_reach("n", "n_b", similarity))
        .select("a", "b")
    )
    to_anchors = members.join(anchors, ["band", "key"]).select("m", F.explode("anchors").alias("anchor"))
    to_anchors = to_anchors.where("m <> anchor").select(F.col("m").alias("a"), F.col("anchor").alias("b"))
    return ordered(close.union(same).union(pairs).union(to_anchors))


def unsettled(members: DataFrame, known: DataFrame) -> DataFrame:
    """(band, key, m, n, part, minor): the classes of large buckets whose classes lie in several components."""
    large = members.where(F.col("members") > PAIRS).select("band", "key", "m", "n")
    parts = cut(
        large.join(known, F.col("m") == F.col("node"), "left").select(
            "band", "key", "m", "n", F.coalesce("component", "m").alias("part")
        )
    )
    by_part = parts.groupBy("band", "key", "part").agg(F.count("*").alias("classes"))
    split = by_part.groupBy("band", "key").agg(
        F.max(F.struct("classes", "part"))["part"].alias("main"), F.count("*").alias("parts")
    )
    split = cut(split.where("parts > 1").select("band", "key", "main"))
    return cut(parts.join(split, ["band", "key"]).select("band", "key", "m", "n", "part", (F.col("part") != F.col("main")).alias("minor")))


def rest(left: DataFrame, anchors: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what remains to be verified among unsettled classes, by their distance to their bucket's first anchor."""
    width = max(1 - similarity, 0.01) + 1e-9
    to_first = left.join(anchors.select("band", "key", F.get("anchors", F.lit(0)).alias("anchor")), ["band", "key"])
    pairs = to_first.where("m <> anchor").select(F.col("m").alias("a"), F.col("anchor").alias("b"))
    pairs = cut(ordered(pairs))
    apart = cut(scored(pairs, among(sets, pairs)).select("a", "b", (1 - F.col("similarity")).alias("distance")))
    far = to_first.join(
        apart, (F.least("m", "anchor") == F.col("a")) & (F.greatest("m", "anchor") == F.col("b")), "left"
    ).select("band", "key", "m", "n", "part", "minor", F.coalesce("distance", F.lit(0.0)).alias("distance"))
    far = cut(far.withColumn("ring", F.floor(F.col("distance") / width)))
    ring = F.explode(F.array(*(F.col("ring") + i for i in (-1, 0, 1)))).alias("ring")
    minor = far.where("minor").select("band", "key", F.col("m").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"), F.col("distance").alias("distance_a"), ring)
    met = minor.join(far, ["band", "key", "ring"]).where(F.col("part") != F.col("part_a"))
    met = met.where(may_reach("n", "n_a", similarity) & (F.abs(F.col("distance") - F.col("distance_a")) <= width))
    return ordered(met.select("a", F.col("m").alias("b")))


def keys_of(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(set_key, set) of texts(set_key, text), a text of each class."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: np.unique(shingle_hashes(t, words)).view(np.int64))

    return cut(texts.select("set_key", sets("text").alias("set")))


def among(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the classes of pairs, of which there may be few."""
    wanted = keys_of(pairs)
    few = wanted.count() <= FEW  # a key is a long
    return cut(sets.join(F.broadcast(wanted) if few else wanted, "set_key", "left_semi"))


def scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either, similarity) of the pairs' sets of shingles."""
    both = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("set_key").alias("b"), F.col("set").alias("set_b")), "b"
    )
    common = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    either = F.col("sum") - F.col("common")
    return counted.select("a", "b", "common", either.alias("either"), (F.col("common") / either).alias("similarity"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose sets of shingles are so similar."""
    return scored(pairs, sets).where(F.col("common") >= F.lit(similarity) * F.col("either")).select("a", "b")


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row_key, group) for every row of docs(doc_id, text)."""
    rows = cut(described(docs, words))
    classes = rows.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "row_key")).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    )
    classes = cut(classes)
    members = bucket_members(classes)
    anchors = anchors_of(members.where(F.col("members") > PAIRS))
    pairs = cut(candidates(classes, members, anchors, similarity))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    # Only classes of a pair are looked up again, so few texts move.
    wanted = keys_of(pairs)
    firsts = cut(classes.join(wanted, "set_key", "left_semi").select("set_key", F.col("first.row_key").alias("k")))
    firsts = F.broadcast(firsts) if firsts.count() <= FEW else firsts
    texts = docs.select(key.alias("k"), "text").join(firsts, "k").dropDuplicates(["set_key"])
    sets = sets_of(texts, words)
    found_links = cut(verified(pairs, sets, similarity))
    known = connected_components(found_links)
    left = unsettled(members, known)
    if not left.isEmpty():
        # Each class of a large bucket has been compared with an anchor, so its set is there.
        more = cut(rest(left, anchors, sets, similarity))
        known = connected_components(found_links.union(verified(more, among(sets, more), similarity)))
    found = classes.select("set_key").join(known, F.col("set_key") == F.col("node"), "left")
    found = found.select("set_key", F.coalesce("component", "set_key").alias("group"))
    return rows.join(found, "set_key").select("doc_id", "row_key", "group")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but the first document, by doc_id, of each group."""
    lean = docs.select("doc_id", "text")
    found = groups(lean, words, similarity)
    kept = cut(found.groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).select("first.row_key"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key.alias("row_key"))
    left = packed.join(kept, "row_key", "left_semi")
    if left.count() > kept.count():  # repeated rows: one of them stays
        left = left.dropDuplicates(["row_key"])
    return left.select("row.*")
