import random

import corpus_pipeline
from ledgerlark.llm import linededup
from ledgerlark.llm import passages as passages_module


def words_left(spark, texts):
    """index -> words left by the pipeline's stage; documents of which nothing is left are missing."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    return {r.doc_id: (r.text or "").split() for r in out.collect()}


def test_later_whole_lines_go_whatever_their_neighbours(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    lines = [fresh(6), fresh(9), fresh(12), "Two units. " + fresh(7), fresh(40), "too short to count"]
    texts, want, seen = [], [], set()
    for d in range(30):
        mine = [line for _ in range(3) for line in (fresh(5), rng.choice(lines))]
        texts.append(rng.choice(("", "\n ")) + rng.choice(("\n", " \r\n", "\n\n")).join(mine) + "\n")
        left = []
        for line in mine:
            if len(line.split()) < 6 or line not in seen:
                left += line.split()
            seen.add(line)
        want.append(left)
    got = words_left(spark, [*texts, None, "", " \n"])
    assert [got[i] for i in range(30)] == want


def brute_runs(rows, k):
    """index -> words that no run of k words earlier in (doc_id, position) covers, as a list of positions gone."""
    seen, out = set(), {}
    for i, text in rows:
        ws = (text or "").split()
        gone = set()
        for at in range(len(ws) - k + 1):
            run = tuple(ws[at : at + k])
            if run in seen:
                gone.update(range(at, at + k))
            seen.add(run)
        out[i] = gone
    return out


def test_runs_by_definition(spark, sf, docs_rows):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    passages = [fresh(n) for n in (24, 25, 26, 60, 200)]
    rows = [(r["doc_id"], r["text"]) for r in docs_rows]
    for d in range(60):  # at any offset of a line, with other white space, without ends of sentences
        words = fresh(rng.randrange(40)) + rng.choice(passages) + fresh(rng.randrange(40))
        rows.append((50_000 + d, "".join(w + rng.choice((" ", " ", "\t", "\n")) for w in words)))
    rows += [(60_000, "w " * 300), (60_001, "a b " * 100), (60_002, rows[0][1]), (60_003, None), (60_004, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: set() for i, _ in rows}
    for r in passages_module.repeated_runs(df).collect():
        got[r.doc_id].update(range(r.span.at, r.span.at + r.span.n))
    want = brute_runs(sorted(rows, key=lambda r: r[0]), passages_module.RUN_WORDS)
    assert got == want and len(want[60_002]) == len(rows[0][1].split())
    twice = spark.createDataFrame([(1, "q " * 40), (1, "q " * 40), (None, "r " * 20)], "doc_id long, text string")
    assert {(r.span.at, r.span.n) for r in passages_module.repeated_runs(twice).collect()} == {(1, 39)}
    assert passages_module.repeated_runs(df.limit(0)).count() == 0


def test_passage_at_any_offset_goes(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(200)
    own = [(fresh(5 + k), fresh(7)) for k in range(24)]
    got = words_left(spark, [" ".join(a + passage + b) for a, b in own])
    assert got == {k: a + b if k else a + passage + b for k, (a, b) in enumerate(own)}


def test_nothing_that_the_operator_deletes_stays(spark, sf, docs_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.row.doc_id: (r.n_removed, r.text) for r in linededup.deduplicate_whole(docs).collect()}
    first, seen = {}, set()
    for r in sorted(docs_rows, key=lambda r: r["doc_id"]):
        for line in (x.strip() for x in r["text"].split("\n")):
            if len(line.split()) >= 6:
                first.setdefault(line, r["doc_id"])
    for r in linededup.deduplicate(docs).collect():
        i, text = r.row.doc_id, r.row.text
        n, left = whole[i]
        assert n == len(text.split()) - len(left.split()) and len(left) <= len(r.text)
        again = [x.strip() for x in text.split("\n") if first.get(x.strip(), i) < i]
        assert not again or n > 0
        seen.update(again)
        assert not {x.strip() for x in left.split("\n")} & set(again)
    assert seen
