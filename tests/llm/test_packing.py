import random
import re
from collections import defaultdict

import numpy as np

from ledgerlark.llm import packing


def check(rows, got, capacities=packing.CAPACITIES):
    largest, bins, parts = max(capacities), defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
        parts[r.doc_id, r.copy].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.position)
        at = 0
        for i, r in enumerate(members):
            assert (r.offset, r.position, r.capacity) == (at, i, members[0].capacity)
            at += r.tokens
        assert at == members[0].used <= members[0].capacity
        assert members[0].capacity == min(c for c in capacities if c >= at)
    lengths = defaultdict(list)
    for doc, text in rows:
        lengths[doc].append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    found = defaultdict(list)
    for (doc, _), rs in parts.items():
        rs.sort(key=lambda r: r.chunk)
        assert [r.start for r in rs] == [largest * i for i in range(len(rs))]
        assert all(r.tokens == largest for r in rs[:-1])
        found[doc].append(sum(r.tokens for r in rs))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in lengths.items()}
    return bins


def test_whole_table(spark, sf, docs_rows):
    got = packing.op6_packing(spark, sf).collect()
    bins = check([(r["doc_id"], r["text"]) for r in docs_rows], got)
    full = sum(rs[0].used for rs in bins.values()) / sum(rs[0].capacity for rs in bins.values())
    assert full > 0.97
    assert sorted(map(str, got)) == sorted(map(str, packing.op6_packing(spark, sf).collect()))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "w " * 20), (3, "w " * 20), (4, "w " * 8), (5, "w " * 9), (None, "a b"), (6, "w " * 1000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bin int")
    got = packing.pack(df, capacities=(4, 8), group_items=40).collect()
    check(rows, got, (4, 8))
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fit_is_the_plain_rule():
    rng = random.Random(5)
    for _ in range(50):
        lengths = np.array([rng.randint(0, 64) for _ in range(rng.randint(0, 60))], np.int64)
        bins, offsets, final = packing.best_fit(lengths, (16, 32, 64), 3)
        rooms, left = [], int(lengths.sum())
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            left -= lengths[i]
            fit = [b for b, r in enumerate(rooms) if r >= lengths[i]]
            if fit:
                b = min(fit, key=lambda b: rooms[b])
            else:
                b = len(rooms)
                rooms.append(packing.cheapest(int(lengths[i]), int(left), (16, 32, 64), 3))
            rooms[b] -= lengths[i]
        # Bins of equal room are interchangeable, so their number and all rooms agree whichever is taken.
        assert len(final) == len(rooms)
        assert sum(final) == sum(min(c for c in (16, 32, 64) if c >= u) for u in np.bincount(bins, lengths, len(rooms)))


def test_equal_rows_spread_over_groups(spark):
    df = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'five words are in here' as text")
    got = packing.pack(df).selectExpr("copy", "substring_index(bin, '-', 1) as group", "bin", "tokens", "capacity", "used")
    sizes = [r["count"] for r in got.groupBy("group").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1.2 * packing.GROUP_ITEMS
    assert got.select("copy").distinct().count() == 100_000 == got.count()
    assert got.where("used > capacity").count() == 0


def test_copies_are_unfolded_in_blocks(spark):
    df = spark.createDataFrame([(1, "a b c")] * 95 + [(2, "d " * 20)] * 11, "doc_id long, text string")
    got = packing.pack(df, capacities=(8, 16), group_items=10).collect()
    check([(1, "a b c")] * 95 + [(2, "d " * 20)] * 11, got, (8, 16))
