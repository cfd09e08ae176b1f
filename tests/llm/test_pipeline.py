import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import similar


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8 or not sets[a] | sets[b]:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def test_groups_against_brute_force(spark, docs_rows):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs_rows]
    vocabulary = [f"w{i}" for i in range(500)]
    for g in range(12):  # planted copies with some words exchanged, and one large group
        words = rng.choices(vocabulary, k=rng.choice((60, 150, 400)))
        for i in range(40 if g == 0 else 4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 50)):
                copy[at] = rng.choice(vocabulary)
            rows.append((10_000 + 100 * g + i, " ".join(copy)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "A b"), (20_004, "a  B")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, fp int")
    want = components(rows)
    kept = similar.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    twice = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "q")], "doc_id long, text string")
    assert similar.one_of_each(twice).count() == 2
    assert similar.one_of_each(df.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With every bucket called large and no other candidates, the exact way alone finds the chains of edits."""
    monkeypatch.setattr(similar, "PAIRS", 1)
    checked, calls = similar.verified, []
    monkeypatch.setattr(
        similar, "verified", lambda *a: calls.append(1) or (checked(*a).limit(0) if len(calls) == 1 else checked(*a))
    )
    rng = random.Random(9)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{rng.randrange(900)}" for _ in range(200)]
        for i in range(25):
            rows.append((100 * chain + i, " ".join(words)))
            at, many = rng.randrange(180), rng.choice((4, 8, 16, 20))
            words[at : at + many] = [f"c{chain}n{rng.randrange(900)}" for _ in range(many)]
    want = components(rows)
    assert len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similar.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_stages(spark, sf, docs_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs_rows}
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(odd), sf)
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == set(before)
    lines = corpus_pipeline.line_dedup(spark, docs, sf)
    assert lines.columns == columns
    for r in lines.collect():
        assert r.n_chars == len(r.text) and r.n_chars <= len(before[r.doc_id]["text"])
    unique = corpus_pipeline.simhash_dedup(spark, docs, sf)
    want = components([(r["doc_id"], r["text"]) for r in docs_rows])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(want.values()))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(before)


CLASHES = ("prediction", "key", "n", "at", "text_key", "row", "target", "copy", "chunk", "bin", "words", "block", "fp", "id", "h")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_at_their_edges(spark, sf, name, stage):
    """Nulls in any column, empty texts, repeated rows, further columns under the stages' own names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"some words of text number {i} that no other row has {i * 7}", "en" if i % 2 else "fr", f"s{i % 3}", 50) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "a lone text without any id", None, None, 26), (50, "", "en", None, 0), (51, "  ", None, "s1", 2)]
    rows += [(52, "twice the same row", "en", "s0", 18)] * 2 + [(53, "long words " * 4000, "en", "s0", 44000)]
    docs = spark.createDataFrame(rows, schema)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    out = stage(spark, docs, sf)
    got = out.collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and len(got) > 20
    if name != "pack_sequences":
        assert out.columns == docs.columns and all(r["key"] == "x" and r["h"] == "x" for r in got)
        assert set(range(40)) <= {r.doc_id for r in got} or name == "mix_sources"
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100
    assert out.where("used > capacity").count() == 0
