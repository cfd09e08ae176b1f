import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerlark.llm import divergence
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(docs):
    """docs are (text, lang, source); term by term, without levels or products."""
    rows = [(TERM.findall((t or "").translate(LOWER)), g or "", s or "") for t, g, s in docs]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(ts, s) for ts, g, s in rows if g == lang]
        within = Counter(t for ts, _ in own for t in set(ts))
        kept = sorted(t for t, n in within.items() if n >= 10)
        v, sources = len(kept), sorted({s for _, s in own})
        p = {}
        for name in (*sources, None):
            c = Counter(t for ts, s in own if name in (s, None) for t in ts)
            n = sum(c[t] for t in kept)
            p[name] = {t: (c[t], 1 + 10**9 * (c[t] + 2) // (n + 2 * v)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for a in sources:
            pairs = [(b, sum(f(p[a][t][1], p[b][t][1]) for t in kept)) for b in sources if b != a]
            terms = [(t, f(p[a][t][1], p[None][t][1])) for t in kept if p[a][t][0] and p[a][t][1] > p[None][t][1]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "'x' as term", "1 as n", "2 as rank")
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def corpus(rng, n):
    words = ["the", "The", "ÉTÉ", "été", "naïve", "漢字", "x9y", "a_b", "it's", *(f"w{chr(97 + i)}" for i in range(26))]
    docs = []
    for _ in range(n):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice([5, 20, 40])]) for _ in range(rng.choice([0, 1, 5, 60])))
        docs.append((rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", "", None]), rng.choice(["a", "b", "c", "", None, "é"])))
    return docs


def test_against_brute_force(spark):
    docs = corpus(random.Random(5), 400)
    docs += [("same text\x00again" * 3, "en", "copies")] * 40 + [("lone", "xx", "only")] * 12 + [("rare", "yy", "p"), (None, "yy", "q")]
    docs += [("long " * 50_000, "en", "a")]
    want = brute(docs)
    assert run(spark, docs) == want
    assert run(spark, docs, block_terms=4) == want  # many blocks


def test_empty_table_and_no_terms(spark):
    assert run(spark, []) == []
    assert run(spark, [("1 2", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_tiles_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    terms, names = [f"t{i:03}" for i in rng.permutation(57)], [f"s{i}" for i in range(7)]
    counts = rng.poisson(2, (57, 7)) * rng.integers(0, 4, (57, 7))
    row, source = np.nonzero(counts)
    totals = counts.sum(axis=0).tolist()
    args = ("en", terms, row, source, counts[row, source].astype(np.int64), names, totals, 57)
    whole = divergence.block_values(*args).to_pylist()
    for name, value in (("SOURCES", 2), ("COLUMNS", 3), ("ROWS", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert divergence.block_values(*args).to_pylist() == whole
    p = 1 + 10**9 * (counts + 2) // (np.array(totals) + 2 * 57)
    want = ((p[:, 0] - p[:, 3]) ** 2 // (p[:, 0] + p[:, 3])).sum()
    assert [r["value"] for r in whole if (r["source"], r["part"], r["item"]) == ("s0", "pair", "s3")] == [want]


def test_probabilities_are_exact_beyond_64_bits():
    counts = np.array([0, 10**13, 10**15])
    assert divergence.probabilities(counts, 10**16 + 1, 3).tolist() == [1 + 10**9 * (c + 2) // (10**16 + 7) for c in (0, 10**13, 10**15)]


def test_terms_of_sliced_batches():
    texts = pa.array(["skip", "Ab9cd é", None, "", "Z"])[1:]
    terms, row = divergence.terms_of(texts)
    assert terms.to_pylist() == ["ab", "cd", "é", "z"] and row.tolist() == [0, 0, 0, 3]


def test_pieces_have_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 30, "", "c" * 4, "d"]})
    parts = list(divergence.pieces(batch, 9))
    assert [p.num_rows for p in parts] == [2, 1, 3] and sum((p["text"].to_pylist() for p in parts), []) == batch["text"].to_pylist()
    assert list(divergence.pieces(batch.slice(0, 0))) == []


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(divergence.op11_source_divergence(spark, sf), divergence.ORACLE, sf) is None
