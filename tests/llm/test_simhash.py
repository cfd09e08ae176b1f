import random

import xxhash

from ledgerlark.llm import simhash


def brute(rows, k=3):
    """doc_id -> (fingerprint hex, component) by comparing all fingerprints."""
    prints = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return {d: (f"{fp:016x}", c) for (d, fp), c in zip(prints.items(), components(list(prints.items())), strict=True)}


def components(items):
    root = {d: d for d, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(items):
        for b, fb in items[:i]:
            if bin(fa ^ fb).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(d) for d, _ in items]


def got(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_whole_table(spark, sf, docs_rows):
    assert got(simhash.op1_simhash(spark, sf)) == brute([(r["doc_id"], r["text"]) for r in docs_rows])


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (1, "One"), (2, "one"), (3, "a b"), (4, "a b c d"), (9, "x\u00a0y Ü ü")]
    rows += [(10, "w " * 50_000), (11, "w " * 50_001)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    twice = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string"))
    assert [r.component_id for r in twice.collect()] == [1, 1, 1]


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    for _ in range(60):  # chains with steps of two bits
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                x ^= 1 << b
    prints |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    items = list(enumerate(sorted(prints)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in items]
    df = spark.createDataFrame([(p, i) for i, p in signed], "fp long, node long")
    from ledgerlark.llm.components import connected_components

    known = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    assert [known.get(i, i) for i, _ in items] == components(items)


def test_a_row_without_doc_id_links_others(spark, monkeypatch):
    rows = [(1, 0), (None, 3), (2, 15), (7, 1 << 40 | 0xFFFF0000), (None, 0x0F0F0F0F)]
    monkeypatch.setattr(
        simhash, "fingerprints", lambda docs, words: spark.createDataFrame(rows, "doc_id long, fp long")
    )
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (2, 1), (7, 7), (None, None)}
