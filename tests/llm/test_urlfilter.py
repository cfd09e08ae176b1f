import fnmatch
import random
import re
import tracemalloc

import pytest

from ledgerlark.llm import urlfilter
from ledgerlark.llm.urlfilter import Automaton


def test_automaton_against_regex():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?c") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 15))).encode() for _ in range(300)]
    texts.append(b"a" * 5000)
    hit = Automaton(globs).run(texts)
    for j, g in enumerate(globs):
        pattern = re.compile(fnmatch.translate(g).encode(), re.S)
        assert [bool(pattern.match(t)) for t in texts] == hit[:, j].tolist(), g


def test_blocks_are_sized_by_states(monkeypatch):
    globs = [f"*{i}*x" for i in range(300)]
    texts = [f"{i}x".encode() for i in range(400)]
    whole = Automaton(globs).run(texts)
    sizes, block = [], Automaton._block
    monkeypatch.setattr(Automaton, "_block", lambda self, part, lengths: (sizes.append(len(part)), block(self, part, lengths))[1])
    monkeypatch.setattr(urlfilter, "BLOCK_WORDS", 1000)
    assert (Automaton(globs).run(texts) == whole).all()
    assert max(sizes) * Automaton(globs).words <= 1000 and sum(sizes) == len(texts)


def test_oracle(spark, sf, sql_rows):
    key = lambda r: r["page_id"]
    got = sorted((r.asDict() for r in urlfilter.op8_url_filter(spark, sf).collect()), key=key)
    assert got == sorted(sql_rows(urlfilter.ORACLE), key=key)


def test_edges(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/net/": ("", "", None, "allow"),
        "http://EXAMPLE.net/en/x?q=http://a.org/fr/": ("example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/enx": ("example.net", "/enx", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/a.net/": ("x.org", "/fr/a.net/", "org/fr/", "allow"),
        "http://x.org/a/.net/": ("x.org", "/a/.net/", None, "allow"),
        "a#b://net/p#f": ("net", "/p", "net/", "block"),
        "http://spam-1.com/": ("spam-1.com", "/", None, "block"),
        "http://x.com/" + "y" * 100_000 + ".exe": ("x.com", "/" + "y" * 100_000 + ".exe", None, "block"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_rules_from_a_table(spark, monkeypatch):
    rules = [("a.com/", "block"), ("a.com/ok/", "allow"), ("b.org/", "allow"), ("b.org/", "block"), ("*|*.zip", "block"), (None, "block"), ("c.net/", "maybe")]
    table = spark.createDataFrame([(*r, 1) for r in rules], "rule string, verdict string, page_id int")
    urls = ["http://x.a.com/p", "http://a.com/ok/p", "http://b.org/", "http://d.de/f.zip", "http://c.net/", "http://a.com/ok/f.zip"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in urlfilter.judge_by(pages, table).orderBy("page_id").collect()]
    assert got == [("a.com/", "block"), ("a.com/ok/", "allow"), ("b.org/", "block"), (None, "block"), (None, "allow"), ("a.com/ok/", "allow")]
    assert urlfilter.judge_by(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)
    same = spark.createDataFrame(list(urlfilter.HOST_RULES) + [(g, "block") for g in urlfilter.DEFAULT_GLOBS], "rule string, verdict string")
    assert urlfilter.judge_by(pages, same).exceptAll(urlfilter.judge(pages)).count() == 0
    monkeypatch.setattr(urlfilter, "MOST_MASKS", 1000)
    with pytest.raises(ValueError, match="states"):
        urlfilter.judge_by(pages, table)


def test_first_match_takes_no_memory_for_all_pairs():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?") for _ in range(6)) for _ in range(3000)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(3000)]
    automaton = Automaton(globs)
    tracemalloc.start()
    first = automaton.first_fit(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150_000_000
    hit = automaton.run(texts[:200])
    assert first[:200].tolist() == [int(h.argmax()) if h.any() else -1 for h in hit]
