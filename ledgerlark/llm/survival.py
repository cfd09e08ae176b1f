"""Operator 13, filter interaction audit by truth-table survival words.

With five filters a document survives 2^5 subsets of them or not: bit S of its 32-bit word is 1 if it fails no filter
of subset S. How many documents survive each subset is a positional popcount of the words, done by carry-save adders:
three words of one weight become a word of sums and a word of carries of twice the weight, so counters stay in bit
planes until a partition ends. Partitions emit 32 counts for each part and label, and Spark adds these up.

Everything reported follows from survivors by subset. With the filters P before it, a filter f removes
n(P) - n(P + f); of those that fail it, n() - n(f), the others were removed before; documents that fail f alone are
n(all but f) - n(all); and its Shapley sum weighs n(S) - n(S + f) by the orders in which exactly S comes before f.

Spark's part: flags are DataFrame functions. A document is a later copy if its (digest of the text, doc_id) is not the
least doc_id of that digest; both sides are spread by digest and doc_id, so a text with a third of all rows is in no one
task, and the least doc_id is found by partial sums. A digest is SHA-256, taken as the text itself.

Edge cases: null text is empty, null lang part ''; null doc_id is no copy of any and makes none; rows with equal doc_id
are not copies of each other; a document counts as good or toxic if any of its label rows says so, and without labels
as neither; repeated rows count each; an empty table gives no parts; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.shared import SPACE, table

#: The contract's filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = r"[#$%&*|]"


def words_of(failed: np.ndarray, filters: int) -> np.ndarray:
    """The survival word of each mask of failed filters."""
    masks = np.arange(1 << filters)
    bits = (masks[:, None] & masks[None, :]) == 0
    table_of = (bits << masks.astype(np.uint64)[None, :]).sum(axis=1).astype(np.uint32)
    return table_of[failed]


class BitCounter:
    """Positional popcount: planes[k] holds words that count 2^k each, at most two after add()."""

    def __init__(self) -> None:
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        carry, k = words, 0
        while len(carry):
            if k == len(self.planes):
                self.planes.append(np.zeros(0, np.uint32))
            now, carries = np.concatenate((self.planes[k], carry)), []
            while len(now) > 2:
                third = len(now) // 3
                a, b, c, rest = now[:third], now[third : 2 * third], now[2 * third : 3 * third], now[3 * third :]
                half = a ^ b
                carries.append((a & b) | (half & c))
                now = np.concatenate((half ^ c, rest))
            self.planes[k] = now
            carry, k = np.concatenate(carries) if carries else np.zeros(0, np.uint32), k + 1

    def counts(self, positions: int) -> list[int]:
        """How many of the words added had each bit."""
        return [sum(int((p >> np.uint32(i) & 1).sum()) << k for k, p in enumerate(self.planes)) for i in range(positions)]


def survivors(rows: DataFrame, filters: int) -> DataFrame:
    """(part, good, toxic, subset, n): how many of rows(part, good, toxic, failed) survive each subset of filters."""
    schema = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], BitCounter] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch["part"].dictionary_encode()
            names = coded.dictionary.to_pylist()
            good, toxic = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
            key = coded.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
            words = words_of(batch["failed"].to_numpy(), filters)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for at in np.split(order, cuts):
                k = int(key[at[0]])
                found.setdefault((names[k // 4], k % 4), BitCounter()).add(words[at])
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in keys], pa.string()),
                pa.array([k >= 2 for _, k in keys], pa.bool_()),
                pa.array([k % 2 == 1 for _, k in keys], pa.bool_()),
                pa.array([found[k].counts(1 << filters) for k in keys], pa.list_(pa.int64())),
            ],
            schema=schema,
        )

    parts = rows.select("part", "good", "toxic", "failed").mapInArrow(
        count, "part string, good boolean, toxic boolean, counts array<long>"
    )
    by_subset = parts.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    return by_subset.groupBy("part", "good", "toxic", "subset").agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, filters: str) -> DataFrame:
    """The audit of every order of the filters, from survivors()."""
    size, full = len(filters), (1 << len(filters)) - 1
    kinds = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")), "toxic": F.when(F.col("toxic"), F.col("n"))}
    sums = counted.groupBy("part", "subset").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in kinds.items()))
    # 2^filters entries for each part.
    listed = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *kinds))).alias("by"))
    wide = listed.select("part", *(F.col(f"by.{k}").alias(k) for k in kinds))

    def shapley(f: int) -> Column:
        terms = []
        for before in (s for s in range(full + 1) if not s >> f & 1):
            orders = math.factorial(before.bit_count()) * math.factorial(size - 1 - before.bit_count())
            terms.append((F.col("n")[before] - F.col("n")[before | 1 << f]) * F.lit(orders))
        return sum(terms[1:], terms[0])

    wide = wide.select("*", F.array(*(shapley(f) for f in range(size))).alias("shapley_of"))
    steps = []
    for order in itertools.permutations(range(size)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, f, 1 << f, before, before | 1 << f, full ^ 1 << f))
            before |= 1 << f
    names = ("filter_order", "step", "f", "alone", "before", "after", "others")
    plan = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, names, strict=True))) for s in steps))
    each = wide.select("*", F.inline(plan))
    at = lambda kind, subset: F.col(kind)[F.col(subset)]
    removed = at("n", "before") - at("n", "after")
    return each.select(
        "part",
        "filter_order",
        "step",
        at("n", "after").alias("kept"),
        removed.alias("removed"),
        (F.col("n")[0] - at("n", "alone") - removed).alias("redundant"),
        (at("n", "others") - F.col("n")[full]).alias("unique_fails"),
        (at("good", "before") - at("good", "after")).alias("good_lost"),
        (at("toxic", "before") - at("toxic", "after")).alias("toxic_lost"),
        F.col("shapley_of")[F.col("f")].alias("shapley"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, good, toxic, failed) for every row of docs(doc_id, text, lang); bit k of failed is filter k's."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    words = F.array_remove(F.split("text", f"[{SPACE}]+"), "")
    looked = rows.select("doc_id", "part", "text", words.alias("words"), F.sha2("text", 256).alias("digest"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (
        F.size("words") < LEAST_WORDS,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * 50,
        capitals.cast("long") * 100 > F.length("text").cast("long") * 3,
        F.col("text").rlike(SYMBOLS),
    )
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(fails)), F.lit(0))
    masked = looked.select("doc_id", "part", "digest", mask.alias("failed"))
    first = masked.groupBy("digest").agg(F.min("doc_id").alias("first")).where("first is not null")
    first = first.select(F.col("digest").alias("first_digest"), "first")
    marked = masked.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    told = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    joined = marked.join(told, F.col("doc_id") == F.col("labelled"), "left")
    label = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    failed = (F.col("failed") + copy.cast("int") * (1 << len(fails))).cast("int").alias("failed")
    return joined.select("doc_id", "part", label("good"), label("toxic"), failed)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows for docs(doc_id, text, lang) and labels(doc_id, quality, toxic)."""
    return interactions(survivors(failures(docs, labels), len(FILTERS)), FILTERS)


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
l as (select doc_id as labelled, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic
  from labels group by 1),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
d as (select doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} as fails
  from w left join l on doc_id = labelled),
p as (select part, (case when fails.A then 'A' else '' end) || (case when fails.B then 'B' else '' end)
    || (case when fails.C then 'C' else '' end) || (case when fails.D then 'D' else '' end)
    || (case when fails.E then 'E' else '' end) as failed,
    count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from d group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e
  where a.f not in (b.f, c.f, d.f, e.f) and b.f not in (c.f, d.f, e.f) and c.f not in (d.f, e.f) and d.f <> e.f),
s as (select filter_order, cast(unnest(range(1, 6)) as integer) as step from o),
q as (select filter_order, step, filter_order[step] as f, filter_order[1:step - 1] as before from s),
r as (select p.part, filter_order, step, f,
    cast(sum(case when failed = '' or not regexp_matches(failed, '[' || before || f || ']') then n else 0 end) as bigint) as kept,
    cast(sum(case when contains(failed, f) and (before = '' or not regexp_matches(failed, '[' || before || 'x]'))
      then n else 0 end) as bigint) as removed,
    cast(sum(case when contains(failed, f) and before <> '' and regexp_matches(failed, '[' || before || 'x]')
      then n else 0 end) as bigint) as redundant,
    cast(sum(case when failed = f then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when contains(failed, f) and (before = '' or not regexp_matches(failed, '[' || before || 'x]'))
      then good else 0 end) as bigint) as good_lost,
    cast(sum(case when contains(failed, f) and (before = '' or not regexp_matches(failed, '[' || before || 'x]'))
      then toxic else 0 end) as bigint) as toxic_lost
  from p, q group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from r
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
