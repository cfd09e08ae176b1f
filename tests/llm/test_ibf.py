import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm import ibf


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def sets(text):
    """The pieces of a text, as tuples of words: cut by digests, words and lines, one word after another."""
    words = re.findall(r"[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*|^[ \t\n\x0B\f\r]+", text or "")
    found, piece = set(), []
    for i, word in enumerate(words):
        piece.append(word)
        pair = xx(xx(word.encode()).to_bytes(8, "little"))
        if i + 1 < len(words):
            pair = xx(xx(words[i + 1].encode()).to_bytes(8, "little"), pair)
        signed = pair - (1 << 64) if pair >> 63 else pair
        if signed % ibf.PIECE_WORDS == 0 or "\n" in word or i + 1 == len(words):
            found |= {tuple(piece[k : k + ibf.MOST_WORDS]) for k in range(0, len(piece), ibf.MOST_WORDS)}
            piece = []
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        near = [jaccard(sets(text), sets(x)) for x in (edited, after)]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()}


def test_whole_table(spark, sf, docs_rows):
    df = ibf.op7_fingerprints(spark, sf)
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in docs_rows])
    rows = df.select("retried_edited", "retried_next").collect()
    for side in ("retried_edited", "retried_next"):
        assert sum(r[side] == 0 for r in rows) >= 0.9 * len(rows)


def test_likeness_needs_the_written_fingerprints_only(spark):
    few, many = "\n".join(map(str, range(9))), "\n".join(map(str, range(5, 600)))
    like = "\n".join(map(str, range(2, 10)))
    rows = [(few, like), (few, many), (many, few), ("", ""), ("", few), (many, many)]
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select(*(ibf.written(ibf.fingerprint(ibf.digests(F.col(c)))).alias(c) for c in "ab"))
    near = [r.near for r in ibf.likeness_of_written(df, "a", "b").collect()]
    # Null, if a table does not peel, is allowed once; whatever is told is right.
    assert all(n in (None, jaccard(sets(x), sets(y))) for n, (x, y) in zip(near, rows, strict=True))
    assert near.count(None) <= 1


def test_groups_that_fail_are_retried(spark, monkeypatch):
    monkeypatch.setattr(ibf, "LOAD", 1000)
    rng = random.Random(3)
    texts = ["\n".join(str(rng.randint(0, 500)) for _ in range(n)) for n in (0, 5, 24, 60, 80, 150, 90, 200, 300)]
    rows = list(enumerate(texts))
    df = ibf.compare(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    assert got(df) == brute(rows)
    assert df.where("retried_next > 0").count() > 3


def test_work_grows_with_the_text(spark):
    def cells(lines):
        rows = [(i, "\n".join(f"{i} {j}" for j in range(lines))) for i in range(2)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(ibf.compare(df)) == brute(rows)
        prints = F.transform(F.array(ibf.digests(F.col("text"))), ibf.fingerprint)
        return df.select(F.size(F.flatten(F.get(prints, F.lit(0))["tables"])).alias("n")).first().n

    small, large = cells(2_000), cells(16_000)
    assert small <= 16 * 2_000 and large <= 8 * small


def test_a_word_put_in_changes_the_pieces_around_it_only(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 10))) for _ in range(740)]
    text = " ".join(words)[:5201]
    changed = text[:9] + " inserted " + text[9:]
    df = spark.createDataFrame([(text, changed)], "a string, b string")
    prints = df.select(*(F.get(F.transform(F.array(ibf.digests(F.col(c))), lambda k: ibf.written(ibf.fingerprint(k))), F.lit(0)).alias(c) for c in "ab"))
    near = ibf.likeness_of_written(prints, "a", "b").first().near
    assert near > 0.9 and near == jaccard(sets(text), sets(changed))
    assert len(prints.first().a) <= len(text) / 2


def test_fingerprints_are_shorter_than_half_of_long_texts(spark, sf):
    long = ibf.op7_fingerprints(spark, sf).where("n_chars > 5000").selectExpr("length(fingerprint) / n_chars as share").collect()
    assert long and sum(r.share for r in long) / len(long) <= 0.5


def test_edges(spark):
    texts = [None, "", "x", "one\ntwo\nthree\n", "one\ntwo\nthree\n", "é😀" * 300, "\n\n\n", None]
    texts += ["\n".join(f"line {i}" for i in range(900)), "\n".join(f"line {i}" for i in range(40, 900)), "y" * 100_000]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    out = ibf.compare(df)
    assert got(out) == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in out.collect()}
    assert prints[9] == prints[12] and prints[0] == prints[3] and prints[6] != prints[9]
    assert ibf.compare(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "a\nb")] * 2, "doc_id long, text string")
    assert [r.near_next for r in ibf.compare(one).collect()] == [1.0, 1.0]
