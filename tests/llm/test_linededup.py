import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm import linededup

SPACE = " \t\n\x0b\f\r"


def units(text):
    """The units of a text and the line of each, word by word as the docstring says."""
    pieces = re.findall(rf"[^{SPACE}]+[{SPACE}]*", text or "")
    words = [p.rstrip(SPACE) for p in pieces]
    ends_line = ["\n" in p or i == len(pieces) - 1 for i, p in enumerate(pieces)]
    ends = [e or w[-1] in ".!?" for e, w in zip(ends_line, words)]
    out, line, at = [], 0, 0
    while at < len(words):
        ahead = range(at, min(at + linededup.UNIT_WORDS, len(words)))
        last = next((i for i in ahead if ends[i]), None)
        if last is None:
            cuts = (i for i in ahead[linededup.LEAST_CUT : -1] if len(words[i]) == linededup.CUT_CHARS)
            last = next(cuts, ahead[-1])
        out.append(("".join(pieces[at : last + 1]), line))
        line += ends_line[last]
        at = last + 1
    return out


def brute(rows, window=linededup.WINDOW, least=linededup.LEAST_WORDS):
    """doc index -> (units, removed, text): windows and whole lines that occurred earlier lose all units."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        found = units(text)
        bare = [u.rstrip(SPACE) for u, _ in found]
        gone = set()
        for at in range(len(found) - window + 1):
            run = tuple(bare[at : at + window])
            if sum(len(u.split()) for u in run) < least:
                continue
            if run in seen:
                gone.update(range(at, at + window))
            seen.add(run)
        for n in {n for _, n in found}:
            own = [j for j, (_, m) in enumerate(found) if m == n]
            line = "\1".join(bare[j] for j in own)
            if len(line.replace("\1", " ").split()) >= least:
                if line in seen:
                    gone.update(own)
                seen.add(line)
        lead = re.match(linededup.LEAD, text or "").group()
        kept = lead + "".join(u for j, (u, _) in enumerate(found) if j not in gone)
        out[i] = (len(found), len(gone), text if not gone else kept)
    return out


def test_whole_table_and_oracle(spark, sf, docs_rows, sql_rows):
    got = {r.doc_id: tuple(r)[1:] for r in linededup.op3_line_dedup(spark, sf).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs_rows])
    assert got == want and any(r[1] for r in want.values())
    assert got == {r["doc_id"]: (r["n_units"], r["n_removed"], r["text"]) for r in sql_rows(linededup.ORACLE)}


def test_edges(spark):
    passage = "One two three four. Five six seven! Eight nine ten eleven twelve thirteen? Last words here."
    texts = [
        None,
        "",
        " \n ",
        f"Start of it. {passage} End.",
        f"\n Other begin here now.\n{passage}\tMore to say.",
        "Same line again.\n" * 30,
        "a. b. c. d. " * 5,
        "w " * 100 + "\n" + "w " * 100,
        "no sentence end at all " * 5000,
        f"{passage}",
        "Ünïcode hier. Noch ein Satz da! Und jetzt drei Wörter mehr. x",
        "Ünïcode hier. Noch ein Satz da! Und jetzt drei Wörter mehr. x",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, units int, row string")
    out = linededup.deduplicate(df)
    got = {r.row.doc_id: (r.n_units, r.n_removed, r.text) for r in out.collect()}
    want = brute(rows)
    for i, _ in rows:
        assert got[i] == want[i], i
    assert got[9][2] == "" and got[5][2].count("Same") == 1 and got[11][2] == "" and got[10][1] == 0
    assert linededup.deduplicate(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    rows = linededup.deduplicate(twice).select(F.col("row.doc_id"), "text").collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, passage), (1, ""), (1, "")]


def test_long_lines_are_cut_alike_at_any_offset(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"y{rng.randrange(10 ** rng.randint(1, 9))}" for _ in range(n)]
    passage = fresh(200)
    rows = [(k, " ".join(fresh(5 + k) + passage + fresh(7))) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in linededup.deduplicate(df).collect():
        left = len(r.text.split())
        assert left == 212 if r.row.doc_id == 0 else left <= 12 + r.row.doc_id + 60


def test_one_equal_digest_deletes_nothing(spark, monkeypatch):
    """With all first digests equal, what the second ones tell apart stays."""
    texts = ["A one two three. B four five. C six seven eight.", "A one two three. B four five. C six seven nine."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    right = linededup.described

    def collided(docs, window):
        found = right(docs, window)
        alike = F.transform("prints", lambda x: x.withField("print", F.lit(1).cast("long")))
        lines = F.transform("lines", lambda x: x.withField("print", F.lit(1).cast("long")))
        return found.withColumns({"prints": alike, "lines": lines})

    monkeypatch.setattr(linededup, "described", collided)
    assert {r.row.doc_id: r.text for r in linededup.deduplicate(df).collect()} == dict(enumerate(texts))


def test_only_lines_that_windows_touch_are_cut_again(spark):
    """A line that is deleted or kept whole is not cut into units a second time, and the rows are those of brute force."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" + rng.choice(["", "", ".", ", "]) for _ in range(n)) + "."
    shared = [line(rng.choice([3, 9, 40])) for _ in range(12)]
    rows = []
    for i in range(30):
        lines = rng.sample(shared, 4) + [line(25), line(9) + " " + rng.choice(shared) + " " + line(5)]
        rng.shuffle(lines)
        rows.append((i, rng.choice(["", "\n ", "\t"]) + rng.choice(["\n", " \n\n  "]).join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: (r.n_units, r.n_removed, r.text) for r in linededup.deduplicate(df).collect()}
    assert got == brute(rows)
    one = spark.createDataFrame(
        [("A b c. D e f. G h i.\nOne line. It stays. As it is.\n", [0, 3], [0], [(0, 3)], 6)],
        "text string, begins array<int>, starts array<int>, spans array<struct<at int, n int>>, n_units int",
    )
    whole = one.select(linededup.units_where_needed(F.col("text"), 3, 6).alias("u")).first().u
    assert whole == ["A b c. D e f. G h i.\n", "", "", "One line. It stays. As it is.\n", "", ""]
    part = one.withColumn("starts", F.array(F.lit(2))).select(linededup.units_where_needed(F.col("text"), 3, 6).alias("u"))
    assert part.first().u == ["A b c. ", "D e f. ", "G h i.\n", "One line. ", "It stays. ", "As it is.\n"]
