import hashlib
import re

from ledgerlark.llm import secrets

PATTERNS = {
    "assign": (re.compile(secrets.ASSIGN, re.A), 2, 8),
    "access": (re.compile(secrets.ACCESS), 0, 16),
    "hex": (re.compile(secrets.HEX), 0, 32),
}


def brute(text, scope=secrets.SCOPE):
    text = text or ""
    found = {
        k: [m.span() for m in p.finditer(text) if len(m.group(g)) >= least] for k, (p, g, least) in PATTERNS.items()
    }
    near = lambda a, bs: any(a[0] <= b[1] + scope and a[1] >= b[0] - scope for b in bs)
    spans = lambda p: [m.span() for m in re.finditer(p, text)]
    weak = [s for s in spans(secrets.SECRET) if near(s, found["access"])]
    ends = [s for s in spans(secrets.ENDPOINT) if near(s, found["access"]) and near(s, weak)]
    rows = [(s, i, e, k) for i, k in enumerate(found) for s, e in found[k]]
    join = lambda rs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(rs))
    more = [(s, 3, e, "secret") for s, e in weak] + [(s, 4, e, "endpoint") for s, e in ends]
    return (
        *(len(found[k]) for k in found),
        hashlib.sha256(join(rows).encode()).hexdigest(),
        join(rows + more),
    )


KEY = "AKIA" + "Q" * 16
SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def test_whole_table(spark, sf, docs_rows):
    got = {r.doc_id: tuple(r)[1:] for r in secrets.op4_secrets(spark, sf).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs_rows}


def test_edges(spark):
    texts = [
        None,
        "",
        "secret: token :abcdefghij",
        "Password='aB9_.-+/=x' PASSWD : 12345678 api-key=12345678 apikey=1234567 API_KEY==========",
        f"😀é {KEY} then {SECRET} at https://x.example/y",
        f"{SECRET} alone https://x.example/y",
        f"{KEY} {'.' * 399} {SECRET}",
        f"{KEY} {'.' * 398} {SECRET} {'.' * 500} https://far.example",
        "0123456789abcdef" * 2 + "g" + "0123456789abcdef" * 2 + "f" * 31 + " f" * 40,
        "AKIAAKIA1234567AKIA 123 AKIA12345678901 AKIA123456789012",
        f"token={SECRET} " * 3000,
        f"{KEY} {SECRET} \n" * 400,
        "ſecret=abcdefghij toKen=abcdefghij",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t and t[:60]
    again = spark.createDataFrame([(1, texts[4]), (1, texts[4]), (None, texts[4])], "doc_id long, text string")
    rows = secrets.scan(again).collect()
    assert [tuple(r)[1:] for r in rows] == [brute(texts[4])] * 3
    assert secrets.scan(df.limit(0)).count() == 0
