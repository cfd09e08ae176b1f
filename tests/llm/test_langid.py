import zlib

import numpy as np
import pytest

from ledgerlark.llm import langid


def test_held_out_accuracy(spark, sf, docs_rows):
    got = {r.doc_id: r for r in langid.op9_language(spark, sf).collect()}
    assert len(got) == len(docs_rows)
    right = []
    for r in docs_rows:
        g = got[r["doc_id"]]
        assert g.held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= g.score <= 1
        if g.held_out:
            right.append(g.lang_pred == r["lang"])
    assert np.mean(right) > 0.97 and len(right) > 30
    again = {r.doc_id: r for r in langid.op9_language(spark, sf).collect()}
    assert {d: r.lang_pred for d, r in again.items()} == {d: r.lang_pred for d, r in got.items()}


def test_edges(spark):
    words = {"aa": "abc bca cab ", "bb": "xyz zyx yxz "}
    rows = [(i, words[x] * (i % 3 + 1), x) for i, x in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "123 !?", "bb"), (103, "xyz xyz", None), (104, "Ω", None)]
    rows += [(105, "1 " * 300_000 + "abc", None), (None, "abc cab", None), (106, "zyx", None), (106, "zyx", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert [by[i].lang_pred for i in (103, 105, None, 106)] == ["bb", "aa", "aa", "bb"]
    assert by[104].lang_pred in words
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = langid.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_nystroem_scores_match_the_kernel_form():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(a), 60)) for a in ("abcde ", "defgh ", "xyza ") for _ in range(20)]
    labels = [x for x in ("a", "d", "x") for _ in range(20)]
    seen = np.array([langid.presence(t) for t in texts])
    model = langid.fit(labels, seen)
    v = langid.vectors(seen).astype(float)
    gram = np.zeros((60, 60))
    for i in range(60):
        for j in range(60):
            w = langid.weights()
            gram[i, j] = (w * (seen[i] & seen[j])).sum() / np.sqrt((w * seen[i]).sum() * (w * seen[j]).sum())
    assert np.allclose(gram, v @ v.T, atol=1e-6)
    # With every text a landmark, the Nystroem form is exact kernel ridge regression.
    y = np.where(np.array(labels)[:, None] == np.array(model.langs)[None], 1.0, -1.0)
    dual = np.linalg.solve(gram + langid.RIDGE * 20 * np.eye(60), y)
    assert (gram @ dual).argmax(1).tolist() == (v @ model.scorer).argmax(1).tolist()
    assert gram @ dual == pytest.approx(v @ model.scorer, abs=2e-2)


def test_repeated_rows_do_not_widen_the_sample(spark, monkeypatch):
    seen = []
    right = langid.fit
    monkeypatch.setattr(langid, "fit", lambda labels, bits: seen.append(len(labels)) or right(labels, bits))
    rows = [(None, f"the cat number {i % 7} sat on the mat", "en") for i in range(900)]
    rows += [(3, "der Hund lief um das Haus", "de")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langid.learned(df)
    assert seen == [2 * langid.SAMPLE]
    monkeypatch.setattr(langid, "MOST_ROWS", 20)
    langid.learned(df)
    assert seen[1] == 20


def test_unknown_languages_fit_none(docs_rows):
    """Nearly all long texts of other letters fit none of four languages; texts not learned from fit."""
    rng = np.random.default_rng(3)
    invented = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(150))
    odd = [invented("абвгдежзиклмнопрст") for _ in range(20)] + [invented("bcdfghjklmnpqrstvwxz") for _ in range(20)]
    labelled = [r for r in docs_rows if r["lang"] and r["text"]]
    for langs in (["de", "en"], ["de", "en", "es", "fr"]):
        own = [r for r in labelled if r["lang"] in langs]
        learn, rest = own[::2], own[1::2]
        model = langid.fit([r["lang"] for r in learn], np.stack([langid.presence(r["text"]) for r in learn]))
        assert sum(model.predict(odd)[2]) == 40 if len(langs) == 2 else sum(model.predict(odd)[2]) <= 4
        assert all(model.predict([r["text"] for r in rest])[2])
    assert langid.fit([], np.zeros((0, sum(langid.BINS)), bool)).predict(odd)[2] == [True] * 40
