"""Operator 8, URL filters by a bit-parallel wildcard automaton.

All glob rules are packed side by side into Shift-And masks of several 64-bit words. A batch of canonical URLs is
run as a matrix (URLs x words): each step takes one byte of every URL that is still that long, so all patterns
over all URLs of the batch advance at once. `*` is a state that keeps itself alive, `?` any one byte.

A canonical URL is `.host`, a zero byte, and the path; the host is lower-cased in A-Z. A rule `host/path` becomes
the glob `*.host<0>path*`, so it fits its host and every subdomain but never text inside the path.

Verdict: the longest fitting host rule decides. Without one, the URL is blocked if a glob of DEFAULT_GLOBS matches
the canonical URL, and allowed otherwise.

Edge cases: a null url or one without `://` has empty host and path, no rule and verdict allow; empty tables give no
rows; repeated rows stay; very long urls cost steps only for themselves; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.shared import table

#: Fixed rules of the contract: host/path and verdict.
HOST_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: What is blocked where no host rule fits; `|` stands between host and path.
DEFAULT_GLOBS = ("*.spam*.*|*", "*spam-farm*|*", "*.ads.*|*", "*.tracker?.*|*", "*|*/wp-login*", "*|*.exe")

SEPARATOR = "\x00"
#: Bytes of text, and 64-bit words of state, in a block of URLs that is run at once.
BLOCK_BYTES = 8_000_000
BLOCK_WORDS = 2_000_000
#: Bytes of masks that an executor's Python worker may hold for rules from a table.
MOST_MASKS = 256_000_000


class Automaton:
    """Shift-And over several patterns; each must match the whole input."""

    def __init__(self, globs: list[str]) -> None:
        self.globs = globs
        states: list[tuple[int | None, bool]] = []  # byte (None: any), loops
        starts, finals = [], []
        for glob in globs:
            starts.append(len(states))
            states.append((-1, False))  # entered only before the first byte
            for byte in glob.encode():
                if byte == ord("*"):
                    states[-1] = (states[-1][0], True)
                else:
                    states.append((None if byte == ord("?") else byte, False))
            finals.append(len(states) - 1)
        self.words = (len(states) + 63) // 64
        self.table = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros(self.words, np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.finals = finals
        for i, (byte, loops) in enumerate(states):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if byte is None:
                self.table[:, word] |= bit
            elif byte >= 0:
                self.table[byte, word] |= bit
            if loops:
                self.loop[word] |= bit
        for i in starts:
            self.first[i // 64] |= np.uint64(1 << (i % 64))

    def _blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and matches[i, j], whether glob j fits the i-th of these rows, block by block."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        # Rows of like length share a block, so a long text pads no other; with many rules a block has fewer rows.
        at = 0
        while at < len(order) and self.globs:
            longest = int(lengths[order[at]])
            rows = max(1, min(len(order) - at, BLOCK_BYTES // max(1, longest), BLOCK_WORDS // max(1, self.words)))
            part = order[at : at + rows]
            yield part, self._block([texts[i] for i in part], lengths[part])
            at += rows

    def run(self, texts: list[bytes]) -> np.ndarray:
        """matches[i, j]: whether glob j fits text i."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        for part, hit in self._blocks(texts):
            out[part] = hit
        return out

    def first_fit(self, texts: list[bytes]) -> np.ndarray:
        """The first glob that fits each text, or -1; memory does not grow with texts times globs."""
        out = np.full(len(texts), -1)
        for part, hit in self._blocks(texts):
            out[part] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        return out

    def _block(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths[0])
        chars = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)
        state = np.tile(self.first, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        alive = len(texts)
        for j in range(width):
            while alive and lengths[alive - 1] <= j:
                alive -= 1
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.table[chars[:alive, j]]) | (now & self.loop)
        return np.stack(
            [(state[:, f // 64] >> np.uint64(f % 64)) & one != 0 for f in self.finals], axis=1
        )


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(
    pages: DataFrame,
    host_rules: tuple[tuple[str, str], ...] = HOST_RULES,
    globs: tuple[str, ...] = DEFAULT_GLOBS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url)."""
    rules = sorted(host_rules, key=lambda x: (-len(x[0]), x[0]))
    as_globs = []
    for rule, _ in rules:
        host, slash, path = rule.partition("/")
        as_globs.append(f"*.{host}{SEPARATOR}{slash}{path}*")
    automaton = Automaton(as_globs + [g.replace("|", SEPARATOR) for g in globs])
    n, names = len(rules), [r for r, _ in rules]
    verdicts = np.array([v for _, v in rules] + ["block", "allow"], dtype=object)

    @F.pandas_udf("rule string, verdict string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            # A zero byte in the url itself must not pass for the separator.
            texts = [
                f".{h.replace(SEPARATOR, '%00')}{SEPARATOR}{p.replace(SEPARATOR, '%00')}".encode("utf-8", "replace")
                for h, p in zip(hosts, paths, strict=True)
            ]
            # Host rules stand first, the longest before others.
            first = automaton.first_fit(texts)
            yield pd.DataFrame(
                {
                    "rule": [names[i] if 0 <= i < n else None for i in first],
                    "verdict": verdicts[np.where(first < 0, n + 1, np.minimum(first, n))],
                }
            )

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("v", of("host", "path")).select("page_id", "host", "path", "v.rule", "v.verdict")


def judge_by(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """judge() by a table rules(rule, verdict): host/path with block or allow, or a glob with `|` and block.

    Every task holds the automaton of all rules, so a table whose masks would take over MOST_MASKS bytes is an error. A
    host rule that stands there twice blocks if one of its rows says so; null rules and verdicts are not rules.
    """
    known = rules.where("rule is not null and verdict in ('block', 'allow')")
    # A state for each byte of a rule, and a bit of 257 masks for each state.
    states = known.agg(F.coalesce(F.sum(F.octet_length("rule") + 8), F.lit(0))).first()[0]
    if states * 257 // 8 > MOST_MASKS:
        raise ValueError(f"rules of {states} states need masks of over {MOST_MASKS} bytes")
    found = known.groupBy("rule").agg(F.max("verdict").alias("verdict")).orderBy("rule").collect()
    globs = tuple(r["rule"] for r in found if "|" in r["rule"] and r["verdict"] == "block")
    return judge(pages, tuple((r["rule"], r["verdict"]) for r in found if "|" not in r["rule"]), globs)


ORACLE = """
with s as (
  select page_id,
    case when position('://' in coalesce(url, '')) > 0
      then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*') else '' end as raw_host,
    case when position('://' in coalesce(url, '')) > 0
      then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
h as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path
  from s),
r as (select *, case
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block'
    when rule is not null then 'allow'
    when ('.' || host) like '%.spam%.%' or ('.' || host) like '%spam-farm%' or ('.' || host) like '%.ads.%'
      or ('.' || host) like '%.tracker_.%' or path like '%/wp-login%' or path like '%.exe' then 'block'
    else 'allow' end as verdict
from r
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
