"""Operator 2, mixing sources to target weights, in DataFrame functions only.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words. A target stops at
CAP times its source's words and the excess is reshared by weight. That is water filling: with sources ordered by
CAP * words / weight, those that stop are a prefix, found by running sums over the table of sources.

Blocks. Each document falls into a block of its source by hash, so a source's blocks are random and disjoint and
their order is a permutation. A source is drawn whole as often as its target allows, and then block after block
until the target is reached; inside the last block the documents that still fit are taken, largest first, and the
smallest of the others too if that ends nearer to the target; of several such fillings the nearest counts.
So every document is taken a whole number of times, at most CAP times.

Shards. All drawn blocks are dealt to output shards by a splitting tree: a node holds the number of blocks of each
source for a range of shards and gives its left half a multivariate hypergeometric draw of them, source by source,
until each leaf is a shard with an exact composition. The leaves' quotas are ranges in each source's draw order,
which says what shard a drawn block goes to. Inside a shard rows are put in order of a hash.

Edge cases: null text has 0 words; a source without words has target 0 and taken 0; null source is a source, last
in order; null doc_id is kept; rows of equal doc_id and text share their block and are all taken alike, except in a
last block, where those that fit are counted together; an empty table gives no rows; other columns are passed
through by mixed() and not read by plan(). All randomness is hashing with SEED, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.secrets import let
from ledgerlark.llm.shared import cut, table, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
BLOCK_WORDS = 16_384
SHARD_BLOCKS = 256
#: Tables of sources or blocks of at most so many rows are broadcast, a few MB.
SMALL = 20_000


def looked_up(small: DataFrame) -> DataFrame:
    """A table to join to: sent to all tasks if it is counted to be small, else left to a shuffle."""
    return F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with its place in order and target; one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("double")
    )
    level = F.col("cap") / F.col("weight")
    before = Window.orderBy(level, "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    filled = (
        placed.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("water", F.col("left") / F.col("rest"))
        .withColumn("open", F.when(level >= F.col("water"), F.struct(level, "place", "water")))
        .withColumn("line", F.min("open").over(everything)["water"])
    )
    return filled.select(
        "source", "place", "source_size", F.least("cap", F.coalesce(F.col("line") * F.col("weight"), zero)).alias("target")
    )


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked items are among those drawn without replacement, by inverting the distribution at u.

    Probabilities follow from one another by their ratio; they are summed over all values within about nine
    standard deviations of the mean, which leaves out less than a double can tell.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = 9 * F.sqrt(mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0))) + 2
    low = F.greatest(F.lit(0.0), d + k - n, F.floor(mean - spread).cast("double")).cast("long")
    high = F.least(k, d, F.ceil(mean + spread).cast("double")).cast("long")

    def walk(bounds: Column) -> Column:
        low, high = bounds["low"], bounds["high"]

        def step(acc: Column, x: Column) -> Column:
            v = x.cast("double")
            after = acc["p"] * (k - v) * (d - v) / ((v + 1) * F.greatest(n - k - d + v + 1, F.lit(1.0)))
            return F.struct(
                after.alias("p"),
                (acc["sum"] + acc["p"]).alias("sum"),
                (acc["at"] + F.when(acc["sum"] + acc["p"] <= acc["goal"], 1).otherwise(0)).alias("at"),
                acc["goal"].alias("goal"),
            )

        def run(goal: Column) -> Column:
            start = F.struct(
                F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"), goal.alias("goal")
            )
            return F.aggregate(F.sequence(low, high), start, step)

        return let(run(F.lit(-1.0))["sum"], lambda mass: F.least(high, low + run(mass * u)["at"]))

    return let(F.struct(low.alias("low"), high.alias("high")), walk)


def split(quotas: Column, left_slots: Column, node: Column) -> Column:
    """What the left child gets of each source's blocks: a multivariate hypergeometric draw of left_slots."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(
        total.alias("pool"), left_slots.cast("long").alias("slots"), F.array().cast("array<long>").alias("given")
    )

    def step(acc: Column, q: Column) -> Column:
        u = uniform(node, F.size(acc["given"]))
        return let(
            hypergeometric(acc["pool"], q, acc["slots"], u),
            lambda x: F.struct(
                (acc["pool"] - q).alias("pool"),
                (acc["slots"] - x).alias("slots"),
                F.concat(acc["given"], F.array(x)).alias("given"),
            ),
        )

    return F.aggregate(quotas, start, step, lambda acc: acc["given"])


def shard_quotas(quotas: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(shard, place, quota) from one row of quotas(q array<long>), by a tree over a power of two of shards."""
    nodes = quotas.select("q", F.lit(0).alias("node"))
    width = shards
    while width > 1:
        half = width // 2
        begin = F.col("node").cast("long")
        bound = lambda x: F.floor(x * F.lit(blocks) / F.lit(shards)).cast("long")
        slots = bound(begin + half) - bound(begin)
        nodes = nodes.withColumn("given", split(F.col("q"), slots, F.col("node") * 1024 + F.lit(width)))
        kept = F.zip_with("q", "given", lambda q, g: q - g)
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct(F.col("given").alias("q"), F.col("node").alias("node")),
                    F.struct(kept.alias("q"), (F.col("node") + half).alias("node")),
                )
            ).alias("x")
        ).select("x.*")
        width = half
    return nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("place", "quota"))


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Sized documents with their block, and one row for each block that says how it is drawn."""
    words = word_count(F.col("text"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(SEED))
    sized = docs.withColumns({"size": words, "mix_key": key})
    lean = cut(sized.select("source", "size", "mix_key"))
    sources = cut(
        targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
        .withColumn("full", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
        .withColumn("need", (F.floor("target") - F.col("full") * F.col("source_size")).cast("long"))
    )
    place = looked_up(
        sources.select(F.col("source").alias("of"), "place", "source_size", "target", "blocks", "full", "need")
    )

    def put(df: DataFrame) -> DataFrame:
        block = F.pmod(F.col("mix_key"), F.col("blocks"))
        return df.join(place, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("block", block).drop("of")

    # Running sums over a source's blocks in two steps, so that no task sees all blocks of a large source.
    block = put(lean).groupBy("place", "block", "full", "need").agg(F.sum("size").alias("words"))
    reach = cut(block.withColumn("super", F.floor(F.col("block") / 1024)))
    supers = reach.groupBy("place", "super").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    ahead = Window.partitionBy("place").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(
        F.col("place").alias("p"),
        F.col("super").alias("s"),
        F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base_n"),
        F.sum("n").over(Window.partitionBy("place")).alias("filled"),
    )
    in_order = Window.partitionBy("place", "super").orderBy("block")
    inside = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        reach.join(supers, (F.col("place") == F.col("p")) & (F.col("super") == F.col("s")))
        .withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("words") <= F.col("need"))
        .withColumn("part", ~F.col("whole") & (F.col("before") < F.col("need")))
        # Blocks that no document fell into do not exist, so those that do are numbered without gaps.
        .withColumn("nth", F.col("base_n") + F.row_number().over(in_order) - 1)
        .select("place", "block", "full", "nth", "filled", "whole", "part", (F.col("need") - F.col("before")).alias("room"))
    )
    reach = cut(reach)
    last = reach.where("part").select(F.col("place").alias("p"), F.col("block").alias("b"), "room")
    fits = (
        put(lean.where("size > 0"))
        .join(last, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b")))
        .groupBy("p", "b", "room", "mix_key")
        .agg(F.sum("size").alias("size"))
        .groupBy("p", "b", "room")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "mix_key"))).alias("xs"))
    )
    nothing = F.struct(F.lit(None).cast("long").alias("less"), F.lit(None).cast("long").alias("mix_key"))
    start = F.struct(
        F.col("room").alias("room"), F.array().cast("array<long>").alias("kept"), nothing.alias("least")
    )

    def fill(acc: Column, x: Column) -> Column:
        fit = -x["less"] <= acc["room"]
        return F.struct(
            F.when(fit, acc["room"] + x["less"]).otherwise(acc["room"]).alias("room"),
            F.when(fit, F.concat(acc["kept"], F.array(x["mix_key"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(fit, acc["least"])
            .otherwise(F.struct(x["less"].alias("less"), x["mix_key"].alias("mix_key")))
            .alias("least"),
        )

    def nearest(acc: Column) -> Column:
        """What was kept and how far off it is. The smallest that did not fit goes in if that ends nearer."""
        size = -acc["least"]["less"]
        over = F.coalesce(size - acc["room"] < acc["room"], F.lit(False))
        return F.struct(
            F.when(over, size - acc["room"]).otherwise(acc["room"]).alias("off"),
            F.when(over, F.concat(acc["kept"], F.array(acc["least"]["mix_key"]))).otherwise(acc["kept"]).alias("kept"),
        )

    # Filling is tried from several of the largest documents on, fewer times where documents are many and small.
    tries = F.least(F.lit(32), F.size("xs"), F.greatest(F.lit(1), F.floor(F.lit(4096) / F.size("xs")).cast("int")))
    attempts = F.transform(
        F.sequence(F.lit(1), tries),
        lambda i: F.aggregate(F.slice(F.col("xs"), i, F.size("xs")), start, fill, nearest),
    )
    fits = fits.select("p", "b", F.array_min(attempts)["kept"].alias("kept"))
    drawn = reach.join(fits, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b")), "left").withColumn(
        "draws", F.col("full") + (F.col("whole") | F.col("part")).cast("int")
    )
    drawn = cut(drawn.select("place", "block", "full", "nth", "filled", "whole", "kept", "draws"))

    epoch = F.explode(F.sequence(F.lit(0), F.col("draws") - 1))
    draws = drawn.where("draws > 0").select("place", "block", "full", "nth", "filled", epoch.alias("epoch"))
    # Each whole pass goes through the blocks from another start; the last, partial one takes the first blocks.
    turn = F.pmod(F.col("nth") + F.xxhash64("place", "epoch", F.lit(SEED)) % F.col("filled"), F.col("filled"))
    draws = draws.select(
        "place",
        "block",
        "epoch",
        (F.col("epoch") * F.col("filled") + F.when(F.col("epoch") < F.col("full"), turn).otherwise(F.col("nth"))).alias(
            "turn"
        ),
    )
    per_source = sources.select("place").join(draws.groupBy("place").agg(F.count("*").alias("q")), "place", "left")
    quotas = per_source.select("place", F.coalesce("q", F.lit(0)).alias("q")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "q"))), lambda x: x["q"]).alias("q")
    )
    count = draws.count()
    shards = 1 << max(0, math.ceil(math.log2(max(1, count) / shard_blocks)))
    leaves = shard_quotas(quotas, count, shards).where("quota > 0")
    ends = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = leaves.withColumn("from", F.coalesce(F.sum("quota").over(ends), F.lit(0)).cast("long")).select(
        F.col("place").alias("p"),
        "shard",
        F.explode(F.sequence(F.col("from"), F.col("from") + F.col("quota") - 1)).alias("t"),
    )
    dealt = draws.join(ranges, (F.col("place") == F.col("p")) & (F.col("turn") == F.col("t")))
    homes = dealt.groupBy("place", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("homes")
    )
    how = drawn.join(homes.withColumnsRenamed({"place": "p", "block": "b"}), F.expr("place = p and block = b"), "left")
    how = cut(how.select("place", "block", "full", "whole", "kept", "homes"))
    return put(sized), how.withColumnsRenamed({"place": "in_place", "block": "in_block", "full": "passes"})


def taken(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs with size, source_size, target, copies (how often it is taken) and shards (where each copy goes)."""
    sized, how = plan(docs, **sizes)
    once_more = F.col("whole") | F.coalesce(F.array_contains("kept", F.col("mix_key")), F.lit(False))
    copies = F.col("passes") + F.coalesce(once_more, F.lit(False)).cast("int")
    joined = sized.join(looked_up(how), (F.col("place") == F.col("in_place")) & (F.col("block") == F.col("in_block")), "left")
    return joined.withColumn("copies", copies).withColumn(
        "shards", F.slice(F.coalesce("homes", F.array().cast("array<int>")), F.lit(1), F.col("copies"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs and a row for each copy, dealt into shards and shuffled inside each."""
    packed = docs.select("doc_id", "source", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = taken(packed).select("row", "mix_key", F.posexplode("shards").alias("copy", "shard"))
    return (
        rows.withColumn("order", uniform(F.col("mix_key"), F.col("copy"), F.col("shard")))
        .repartition("shard", F.pmod(F.col("mix_key"), F.lit(16)))
        .sortWithinPartitions("shard", "order")
        .select("row.*")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return taken(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "shards"
    )
