"""Operator 4, secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by pattern: assign, access and hex. Two weak kinds are only candidates: `secret`, a run of
exactly 40 base64 characters, and `endpoint`, an http(s) address. Each alone is mostly noise, so it is reported
only where complementary parts stand within SCOPE code points of it in the same text: a secret needs an access
identifier, an endpoint needs an access identifier and a reported secret. Candidates and identifiers meet in an
interval join on (document, bucket of SCOPE code points) with the distance as residual condition; a bucket holds
a bounded number of spans, and only documents with an identifier and a candidate take part.

Positions are code points, end exclusive. They come from the lengths of the matches and of the pieces between
them, so no text is walked character by character.

Edge cases: null text is empty; a text without finds has counts 0, spans '' and the digest of ''; rows of equal
doc_id and text count as one document for linking and all come out; null doc_id is kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.shared import SPACE, table

#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: For kinds whose match is one run of a class, asking for the least length finds the same spans as dropping
#: shorter matches afterwards, without listing every short run.
LONG_ACCESS = r"AKIA[A-Z0-9]{12,}"
LONG_HEX = r"[0-9a-f]{32,}"
SECRET = r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])"
ENDPOINT = rf"""https?://[^{SPACE}"'<>]+"""

KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 400

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(lengths: Column) -> Column:
    """Sum of all elements before each one, by blocks of about the square root of the size."""

    def by_blocks(xs: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda b: F.slice(xs, b * step + 1, step)
        )
        return let(blocks, over)

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def over(blocks: Column) -> Column:
        return let(
            F.transform(blocks, total),
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda xs, b: let(
                        total(F.slice(sums, F.lit(1), b)),
                        lambda base: F.transform(xs, lambda _, i: base + total(F.slice(xs, F.lit(1), i))),
                    ),
                )
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, by_blocks))


def spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least so many characters."""
    lengths = lambda xs: F.transform(xs, F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = let(
        F.arrays_zip(lengths(gaps).alias("gap"), lengths(matches).alias("match"), lengths(measured).alias("measure")),
        lambda zs: let(
            running_totals(F.transform(zs, lambda z: z["gap"] + z["match"])),
            lambda before: F.filter(
                F.transform(
                    zs,
                    lambda z, i: F.struct(
                        (F.get(before, i) + z["gap"]).alias("start"),
                        F.lit(kind).alias("kind"),
                        (F.get(before, i) + z["gap"] + z["match"]).alias("end"),
                        z["measure"].alias("measure"),
                    ),
                ),
                lambda s: s["measure"] >= least,
            ),
        ),
    )
    plain = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), plain).otherwise(F.array().cast(SPAN))


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(found),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def within(a: DataFrame, b: DataFrame, scope: int) -> DataFrame:
    """Rows of a (key, start, end, ...) that have a row of b within scope code points of the same document."""
    bucket = lambda low, high: F.explode(F.sequence(F.floor(low / scope).cast("int"), F.floor(high / scope).cast("int")))
    left = a.withColumn("bucket", bucket(F.col("start"), F.col("end")))
    right = b.select(
        F.col("key").alias("key2"),
        F.col("start").alias("start2"),
        F.col("end").alias("end2"),
        bucket(F.col("start") - scope, F.col("end") + scope).alias("bucket2"),
    )
    near = (
        (F.col("key") == F.col("key2"))
        & (F.col("bucket") == F.col("bucket2"))
        & (F.col("start") <= F.col("end2") + scope)
        & (F.col("end") >= F.col("start2") - scope)
    )
    return left.join(right, near, "left_semi").drop("bucket").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts, digest of the base spans, all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text), F.length(text)).alias("key"),
        spans(text, ASSIGN, 0, LEAST["assign"], group=2).alias("assign"),
        spans(text, LONG_ACCESS, 1).alias("access"),
        spans(text, LONG_HEX, 2).alias("hex"),
        F.when(text.rlike(LONG_ACCESS), spans(text, SECRET, 3)).otherwise(F.array().cast(SPAN)).alias("weak"),
        F.when(text.rlike(LONG_ACCESS), spans(text, ENDPOINT, 4)).otherwise(F.array().cast(SPAN)).alias("ends"),
    )
    both = base.where((F.size("access") > 0) & (F.size("weak") > 0))
    one = lambda name: both.select("key", F.explode(name).alias("s")).select("key", "s.*").distinct()
    access = one("access")
    secrets = within(one("weak"), access, scope)
    endpoints = within(within(one("ends"), access, scope), secrets, scope)
    linked = (
        secrets.union(endpoints)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
        .withColumnRenamed("key", "of")
    )
    joined = base.drop("weak", "ends").join(linked, F.col("key") == F.col("of"), "left")
    all_base = F.concat("assign", "access", "hex")
    return joined.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(written(all_base), 256).alias("base_sha256"),
        written(F.concat(all_base, F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
