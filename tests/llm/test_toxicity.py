import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm import toxicity
from ledgerlark.llm.toxicity import Lexicon

LEXICON = Lexicon({"vile": 0, "scum": 1, "brack-": 2, "brackli-": 3}, 2)
NOTHING = (1 << 10, 1 << 10 | 1 << 11)


def votes_of(*texts):
    return toxicity.look(pa.array(texts, pa.string()), LEXICON).votes.tolist()


def test_voters():
    bit = lambda v, k: v >> k & 1
    assert votes_of(None, "", "a quiet text") == [1 << 10] * 3
    one, two, stems, hidden = votes_of("vile day" + " x" * 300, "vile SCUM " + "x " * 400, "bracklix brackliy brack " + "x " * 20, "v1le sc@m sc4m?")
    assert [bit(one, k) for k in (0, 1, 3, 4)] == [1, 0, 0, 0]
    assert [bit(two, k) for k in (0, 1, 2, 3)] == [1, 1, 0, 1]
    assert [bit(stems, k) for k in (0, 4, 5, 6)] == [0, 1, 1, 0]  # `brack` itself is no word on the stem
    assert bit(hidden, 12) and not bit(hidden, 0)
    assert bit(votes_of("LOUD LOUD text")[0], 13) and bit(votes_of("what?!?! no")[0], 14)


def test_look_is_the_same_for_slices_and_pieces():
    texts = [None, "vile vile", "é" * 50, "", "brackliab brackliac scum", "v!le"] * 3
    whole = toxicity.look(pa.array(texts), LEXICON)
    for i in range(len(texts)):
        own = toxicity.look(pa.array(texts)[i : i + 1], LEXICON)
        assert own.votes[0] == whole.votes[i] and (own.dense[0] == whole.dense[i]).all()
        at = whole.row == i
        assert own.unit.tolist() == whole.unit[at].tolist() and own.hits.tolist() == whole.hits[at].tolist()


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known rates, voter 2 a copy of voter 1 in nine of ten: without the tree it would count twice."""
    rng = np.random.default_rng(4)
    n = 60_000
    y = rng.random(n) < 0.2
    rates = [(0.8, 0.05), (0.7, 0.1), None, (0.6, 0.02), (0.3, 0.3)]
    votes = []
    for r in rates:
        if r is None:
            votes.append(np.where(rng.random(n) < 0.9, votes[1], rng.random(n) < 0.5))
        else:
            votes.append(rng.random(n) < np.where(y, *r))
    packed = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    label = np.where(rng.random(n) < 0.3, np.where(rng.random(n) < 0.01, ~y, y).astype(int), -1)
    kinds, count = np.unique(np.stack((packed, label)), axis=1, return_counts=True)
    model = toxicity.fit_votes(kinds[0], kinds[1], count, voters=5)
    assert abs(model.prior - 0.2) < 0.02
    edges = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert frozenset((1, 2)) in edges
    own = toxicity.LabelModel(model.prior, model.parent, model.tables, model.label)
    told = 1 / (1 + np.exp(-own.odds(packed, np.full(n, -1))))
    brier, naive = ((told - y) ** 2).mean(), None
    odds = np.full(n, math.log(0.25))
    for v, r in zip(votes, [(0.8, 0.05), (0.7, 0.1), (0.68, 0.14), (0.6, 0.02), (0.3, 0.3)], strict=True):
        odds += np.where(v, math.log(r[0] / r[1]), math.log((1 - r[0]) / (1 - r[1])))
    naive = ((1 / (1 + np.exp(-odds)) - y) ** 2).mean()
    assert brier < naive  # voters taken as independent are surer than they may be
    calibrated = told[(told > 0.3) & (told < 0.7)]
    assert abs(calibrated.mean() - y[(told > 0.3) & (told < 0.7)].mean()) < 0.05


def test_newton_reaches_the_minimum():
    rng = np.random.default_rng(1)
    x, weight = rng.normal(size=(400, 5)), rng.uniform(0.5, 2, 400)
    y = 1 / (1 + np.exp(-(x @ np.array([2, -1, 0, 0, 0.5]) + 0.3)))
    w, bias = toxicity.fit_linear(x, y, weight)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (weight / weight.mean() * (p - y)) + toxicity.RIDGE * w).max() < 1e-2


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def planted(n, seed=7):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 300))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Vile", "scum", f"brack{rng.choice('abcdefgh')}{rng.choice('xyz')}"]))
        docs.append((i, " ".join(words), rng.choice(["en", None])))
        truth[i] = toxic
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return docs, labels, truth


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' as toxic", "1 as score", "2 as unit")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text")


def test_planted_words_and_stems_are_learned(spark):
    docs, labels, truth = planted(700)
    rows = [(9000, None, None), (None, "vile scum vile scum", None), (9001, "", None), (9001, "", None), (9002, "w1 w2 " * 40_000, None)]
    d, t = frames(spark, docs + rows, labels + [(0, 1, None), (None, 1, 1)])
    got = toxicity.scores(d, t)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and held(r.doc_id))
        assert by.setdefault(r.doc_id, r.score) == r.score
    right = sum((by[i] >= 0.5) == x for i, x in truth.items() if held(i))
    assert right >= 0.97 * sum(map(held, truth))
    assert by[9000] < 0.5 and by[9001] == by[9000] and by[9002] < 0.5 and by[None] > 0.5


def test_labels_that_are_held_out_are_not_learned_from(spark):
    docs, labels, _ = planted(300)
    d, t = frames(spark, docs, labels)
    flipped = [(i, q, 1 - x if held(i) else x) for i, q, x in labels]
    a = sorted(map(tuple, toxicity.scores(d, t).collect()))
    b = sorted(map(tuple, toxicity.scores(*frames(spark, docs, flipped)).collect()))
    assert a == b


def test_nothing_to_learn_from(spark):
    docs = [(1, "a", None), (2, None, None)]
    for labels, score in (([], 0.0), ([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0)):
        assert {r.score for r in toxicity.scores(*frames(spark, docs, labels)).collect()} == {score}
    d, t = frames(spark, docs, [(1, 1, 1), (2, 1, 0)])
    assert toxicity.scores(d.limit(0), t).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_documents(spark, sf_dir):
    scored = toxicity.op12_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = scored.join(labels, "doc_id").where("held_out")
    wrong = both.where("predicted <> toxic").count()
    assert wrong <= 0.05 * both.count() and scored.count() == 1000
