import itertools
import random

import numpy as np
import pytest

from ledgerlark.llm import survival
from tests.oracle import compare

SPACES = " \t\n\v\f\r"


def brute(docs, labels):
    """Walks every order of the filters over every document; docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    failed = []
    for i, t, _ in texts:
        words = [w for w in "".join(" " if c in SPACES else c for c in t).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        }
        failed.append({f for f, x in fails.items() if x})
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = []
    for part in sorted({p for _, _, p in texts}):
        own = [(i, f) for (i, _, p), f in zip(texts, failed, strict=True) if p == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                alone = sum(x[1] == {f} for x in own)
                redundant = sum(f in x[1] for x in own) - len(gone)
                lost = [sum(x[0] in known for x in gone) for known in (good, toxic)]
                rows.append((part, "".join(order), step, len(left), len(gone), redundant, alone, *lost, f))
                shapley[f] += len(gone)
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "'x' as failed")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part", "7 as first")
    return sorted(map(tuple, survival.audit(d, t).collect()))


def test_bit_counter_counts_as_a_loop_does():
    rng = np.random.default_rng(1)
    counter, total = survival.BitCounter(), [0] * 32
    for n in (0, 1, 2, 3, 7, 1000, 1, 4096):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        counter.add(words)
        for i in range(32):
            total[i] += int((words >> np.uint32(i) & 1).sum())
    assert counter.counts(32) == total
    assert all(len(p) <= 2 for p in counter.planes)


def test_words_are_truth_tables():
    words = survival.words_of(np.arange(32), 5)
    assert all(bool(int(words[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a" * 30_000, "Ab " * 199 + "b", "ab " * 200, "W" + " w" * 250, "x#", " ".join("abc")]
    texts += [" ".join(f"{rng.choice('xyXY')}{rng.randrange(k)}" for _ in range(n)) for n in (199, 200, 201, 400) for k in (50, 100, 5000)]
    texts += [f"{t}|" for t in texts[-4:]]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "", None, "de"])) for _ in range(150)]
    docs += [(7, "ab", "en")] * 3 + [(None, "ab", "en")] * 2 + [(9, "ab", "en"), (-2, None, "fr")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    rows = run(spark, [(1, None, None)], [])
    assert len(rows) == 600 and rows == brute([(1, None, None)], [])


def test_a_text_of_very_many_copies_is_in_no_one_task(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same' as text", "'en' as lang")
    labels = spark.range(3000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    rows = survival.failures(docs, labels)
    assert rows.where(f"failed = {1 << 4 | 1}").count() == 2999 and rows.where("failed = 1").count() == 1
    one = [r for r in survival.audit(docs, labels).collect() if r.filter_order == "EABCD" and r.step == 1][0]
    assert (one.kept, one.removed, one.good_lost, one.toxic_lost) == (1, 2999, 2999, 1500)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_oracle(spark, sf_dir):
    assert compare(survival.op13_filter_audit(spark, sf_dir), survival.ORACLE, sf_dir) is None
