import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import mixing


def brute_targets(sizes):
    """sizes: source -> words. Reshares the excess until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if now[s] > 3 * sizes[s]]
        if not above:
            return capped | now
        capped |= {s: 3.0 * sizes[s] for s in above}


def check(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += words(text)
    want, sums, smallest = brute_targets(sizes), Counter(), defaultdict(list)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    of = {r[0]: r for r in rows}
    for r in got:
        _, source, text = of[r.doc_id]
        assert (r.size, r.source_size) == (words(text), sizes[source])
        assert r.target == pytest.approx(want[source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        sums[source] += r.taken
        smallest[source].append(r.size)
    return sums, want, smallest


def test_whole_table(spark, sf, docs_rows):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs_rows]
    got = mixing.op2_mixing(spark, sf).collect()
    sums, want, _ = check(rows, got)
    for s, target in want.items():
        assert abs(sums[s] - target) <= max(20, 0.04 * target), s
    assert sorted(map(str, mixing.op2_mixing(spark, sf).collect())) == sorted(map(str, got))


def test_edges_and_small_blocks(spark):
    rows = [(i, "hot", "w " * (i % 40)) for i in range(600)] + [(1000 + i, f"s{i % 5}", "x y z") for i in range(50)]
    rows += [(2000, None, "a b"), (2001, None, None), (2002, "empty", ""), (2003, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.taken(df, block_words=200, shard_blocks=4).withColumn("taken", F.col("size") * F.col("copies")).collect()
    sums, want, sizes = check(rows, got)
    for s, target in want.items():
        assert abs(target - sums[s]) <= max(sizes[s])
    assert all(len(r.shards) == r.copies for r in got)
    per_shard = Counter(x for r in got for x in set(r.shards))
    assert len(per_shard) > 4
    clash = df.withColumns({"size": F.lit("x"), "block": F.lit(1), "target": F.lit(2)})
    mix = mixing.mixed(clash)
    assert mix.columns == clash.columns and mix.count() == sum(
        r.copies for r in mixing.taken(df).collect()
    )
    assert mixing.taken(df.limit(0)).count() == 0


def test_documents_longer_than_a_block_get_all_shards(spark):
    """Such sources have blocks without documents; each drawn copy still has a shard and a row."""
    rows = [(0, "alone", "w " * 100_000)] + [(1 + i, "long", "w " * 40_000) for i in range(10)]
    rows += [(100 + i, "short", "w " * 500) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for sizes in ({}, {"block_words": 3000, "shard_blocks": 4}):
        got = mixing.taken(df, **sizes).select("doc_id", "copies", "shards").collect()
        assert len(got) == len(rows) and all(len(r.shards) == r.copies and None not in r.shards for r in got)
        assert max(r.copies for r in got) > 1
    want = {r.doc_id: r.copies for r in mixing.taken(df).collect() if r.copies}
    assert Counter(r.doc_id for r in mixing.mixed(df).select("doc_id").collect()) == want


def test_hypergeometric_split(spark):
    one = spark.range(1).select(F.array(*map(F.lit, (1000, 37, 0, 1, 300))).cast("array<long>").alias("q"))
    leaves = mixing.shard_quotas(one, 1338, 8).collect()
    by_place, by_shard = Counter(), Counter()
    for r in leaves:
        assert r.quota >= 0
        by_place[r.place] += r.quota
        by_shard[r.shard] += r.quota
    assert [by_place[i] for i in range(5)] == [1000, 37, 0, 1, 300]
    assert all(by_shard[i] == 1338 * (i + 1) // 8 - 1338 * i // 8 for i in range(8))
    # The draw follows its distribution: 20 marked of 50, 10 drawn.
    u = (F.col("id") + 0.5) / 5000
    x = mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u)
    mean, dev = spark.range(5000).select(x.alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert mean == pytest.approx(4, abs=0.02) and dev == pytest.approx((10 * 0.4 * 0.6 * 40 / 49) ** 0.5, abs=0.02)
