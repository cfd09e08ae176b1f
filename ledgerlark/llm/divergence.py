"""Operator 11, source divergence audit by one-hot level products.

How far two sources of a language lie apart is a sum over its kept terms of a price of both probabilities, and a
probability depends on nothing but how often the term occurs in the source: its count level. So it is enough to know,
for each pair of sources and of levels, how many terms have them. Terms are dealt into blocks; a block's indicator
matrix has a row for each term and a column for each (source, level) that occurs in it, level 0 included. The product of
its transpose with itself holds every joint table of the block at once. Products are of tiles of ROWS terms and of COLUMNS
columns, in floats that hold such counts exactly; each cell is then priced once, in integers, and summed.

Spark's part. Each task counts its texts' terms by Arrow, by source and language; Spark adds these up, first by source,
language and term, so that a frequent term is spread by source, then by language and term, with a list that has at most
the language's sources. Kept terms are stored, blocks are cogrouped with their language's totals, and block results are
sums of values or the block's TOP terms of each source, so neither a source nor a language is gathered anywhere.

Edge cases: null text, language and source are ''; repeated rows are documents of their own; a source without terms has
count 0 everywhere; a language without kept terms has value 0 for each pair and no terms; a source alone in its
language has no pairs; ties go by the item's UTF-8; texts of any length are counted whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.shared import fresh_path, table

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 10**9
#: Terms of a block on average, terms of a tile, and sources and columns of a tile.
BLOCK_TERMS = 2048
ROWS = 4096
SOURCES = 256
COLUMNS = 4096
#: Bytes of text that a task looks at together, and counted rows that it keeps before it folds them.
PIECE_BYTES = 6_000_000
FOLD_ROWS = 1_500_000


def _bytes_of_terms() -> np.ndarray:
    """Each byte as it stands in a term, or a space where it ends one: letters, A-Z lowered, and all of other scripts."""
    b = np.arange(256, dtype=np.uint8)
    upper, lower = (b >= 0x41) & (b <= 0x5A), (b >= 0x61) & (b <= 0x7A)
    return np.where(upper, b + 32, np.where(lower | (b >= 0x80), b, 32)).astype(np.uint8)


BYTES = _bytes_of_terms()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after another, and the row of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(BYTES[data]))
    parts = pc.ascii_split_whitespace(plain)
    terms, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    real = pc.not_equal(terms, "")
    return terms.filter(real), np.repeat(np.arange(len(texts)), sizes)[real.to_numpy(zero_copy_only=False)]


COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents by language, source and term; each group also with the term '' and counts of 0."""
    lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    sources = max(1, len(source.dictionary))
    groups, group = np.unique(
        lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy(), return_inverse=True
    )
    terms, row = terms_of(batch["text"])
    coded = terms.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    in_row, n = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
    cell = group[in_row // kinds] * kinds + in_row % kinds
    cells, which = np.unique(cell, return_inverse=True)
    g = np.concatenate((groups[cells // kinds], groups))
    zeros = np.zeros(len(groups), np.int64)
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])
    term = names.take(pa.array(np.concatenate((cells % kinds, zeros + len(coded.dictionary)))))
    return pa.table(
        [
            lang.dictionary.take(pa.array(g // sources)),
            source.dictionary.take(pa.array(g % sources)),
            term,
            pa.array(np.concatenate((np.bincount(which, n, len(cells)).astype(np.int64), zeros))),
            pa.array(np.concatenate((np.bincount(which, minlength=len(cells)), zeros))),
        ],
        schema=COUNTED,
    )


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, by): for each language and term its documents and a list of (source, n); '' lists all sources."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def folded() -> pa.Table:
            if len(kept) == 1:
                return kept[0]
            sums = pa.concat_tables(kept).group_by(["lang", "source", "term"], use_threads=False)
            return sums.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTED.names).cast(COUNTED)

        for batch in batches:
            for piece in pieces(batch):
                kept.append(count_batch(piece))
                if sum(map(len, kept)) > FOLD_ROWS:
                    kept[:] = [folded()]
                    if len(kept[0]) > FOLD_ROWS // 2:
                        yield from kept.pop().to_batches(max_chunksize=100_000)
        if kept:
            yield from folded().to_batches(max_chunksize=100_000)

    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    by_source = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by")
    )


def probabilities(counts: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """The contract's p of each count, in integers of any size until they are divided."""
    return np.array([1 + SCALE * (c + 2) // (total + 2 * kinds) for c in counts.tolist()], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tile:
    """The columns of some sources over some terms: one for each source and level that occurs."""

    def __init__(self, counts: np.ndarray, first: int, totals: list[int], kinds: int) -> None:
        self.first, self.sources = first, counts.shape[1]
        ps, begins, columns, at = [], [], np.empty(counts.shape, np.int64), 0
        for s in range(self.sources):
            levels, which = np.unique(counts[:, s], return_inverse=True)
            ps.append(probabilities(levels, totals[first + s], kinds))
            begins.append(at)
            columns[:, s] = at + which
            at += len(levels)
        self.p, self.begins, self.columns, self.width = np.concatenate(ps), np.array(begins), columns, at

    def indicators(self, begin: int, end: int) -> np.ndarray:
        out = np.zeros((len(self.columns), end - begin), np.float32)
        row, at = np.nonzero((self.columns >= begin) & (self.columns < end))
        out[row, self.columns[row, at] - begin] = 1
        return out


def pair_values(a: Tile, b: Tile) -> np.ndarray:
    """values[i, j]: the price of a's source i with b's source j, summed over the tile's terms."""
    by_column = np.zeros((a.width, b.sources), np.int64)
    spans = lambda t: [(x, min(t.width, x + COLUMNS)) for x in range(0, t.width, COLUMNS)]
    for lo, hi in spans(b):
        right = b.indicators(lo, hi)
        owner = np.searchsorted(b.begins, np.arange(lo, hi), side="right") - 1
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for low, high in spans(a):
            joint = (a.indicators(low, high).T @ right).astype(np.int64)  # at most ROWS in a cell: exact
            priced = joint * price(a.p[low:high, None], b.p[None, lo:hi])
            by_column[low:high, owner[cuts]] += np.add.reduceat(priced, cuts, axis=1)
    return np.add.reduceat(by_column, a.begins, axis=0)


FOUND = "lang string, source string, part string, item string, value long"


def block_values(lang: str, terms: list[str], row: np.ndarray, source: np.ndarray, n: np.ndarray, names: list[str], totals: list[int], kinds: int) -> pa.Table:
    """Values of all pairs of sources over these terms, and each source's TOP terms among them."""
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def tell(part: str, sources: list[str], items: list[str], values: list[int]) -> None:
        out["part"] += [part] * len(values)
        out["source"] += sources
        out["item"] += items
        out["value"] += values

    sums = np.zeros((len(names), len(names)), np.int64)
    order = np.argsort(row, kind="stable")
    for at in range(0, len(terms), ROWS):
        own = order[slice(*np.searchsorted(row[order], (at, at + ROWS)))]
        height = min(ROWS, len(terms) - at)
        tiles = []
        for first in range(0, len(names), SOURCES):
            width = min(SOURCES, len(names) - first)
            part = own[(source[own] >= first) & (source[own] < first + width)]
            counts = np.zeros((height, width), np.int64)
            counts[row[part] - at, source[part] - first] = n[part]
            tiles.append(Tile(counts, first, totals, kinds))
        for i, a in enumerate(tiles):
            for b in tiles[i:]:
                sums[a.first : a.first + a.sources, b.first : b.first + b.sources] += pair_values(a, b)
    a, b = np.triu_indices(len(names), 1)
    for x, y in ((a, b), (b, a)):
        tell("pair", [names[i] for i in x], [names[i] for i in y], sums[a, b].tolist())

    whole = probabilities(np.bincount(row, n, len(terms)).astype(np.int64), sum(totals), kinds) if n.sum() < 1 << 53 else None
    if whole is None:  # too large for the floats of bincount
        exact = [0] * len(terms)
        for r, c in zip(row.tolist(), n.tolist(), strict=True):
            exact[r] += c
        whole = probabilities(np.array(exact, object), sum(totals), kinds)
    rank = np.empty(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
    by_source = np.argsort(source, kind="stable")
    for own in np.split(by_source, np.flatnonzero(np.diff(source[by_source])) + 1):
        if not len(own):
            continue
        s = int(source[own[0]])
        p, q = probabilities(n[own], totals[s], kinds), whole[row[own]]
        more = np.flatnonzero((n[own] > 0) & (p > q))
        value = price(p[more], q[more])
        best = np.lexsort((rank[row[own[more]]], -value))[:TOP]
        tell("term", [names[s]] * len(best), [terms[row[own[more[i]]]] for i in best], value[best].tolist())
    size = len(out["value"])
    return pa.table([pa.array([lang] * size, pa.string()), *(pa.array(out[k], t) for k, t in (("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())))], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank for docs(text, lang, source)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "terms")
    counted_terms(docs).where((F.col("docs") >= LEAST_DOCUMENTS) | (F.col("term") == "")).write.parquet(path)
    kept = spark.read.parquet(path)
    # For each language: its kept terms, and the count of each source over them; sources without any are there by ''.
    each = kept.select("lang", "term", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kinds"))
    totals = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("totals")).join(kinds, "lang")
    most = kinds.agg(F.coalesce(F.max("kinds"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-most // block_terms))
    dealt = spark.read.parquet(path).where("term <> ''").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    told = totals.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def of_block(terms: pa.Table, told: pa.Table) -> pa.Table:
        if not len(terms):
            return pa.Table.from_batches([], pa.schema([(c, pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "part", "item", "value")]))
        totals, kinds = told["totals"][0].as_py(), told["kinds"][0].as_py()
        names = pa.array([t["source"] for t in totals], pa.string())
        by = terms["by"].combine_chunks()
        by = by.combine_chunks() if isinstance(by, pa.ChunkedArray) else by
        entries = by.flatten()
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(by).to_numpy(zero_copy_only=False))
        source = pc.index_in(entries.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        n = entries.field("n").to_numpy(zero_copy_only=False)
        return block_values(terms["lang"][0].as_py(), terms["term"].to_pylist(), row, source, n, names.to_pylist(), [t["n"] for t in totals], kinds)

    found = dealt.select("lang", "block", "term", "by").groupBy("lang", "block").cogroup(told.groupBy("lang", "block"))
    values = found.applyInArrow(of_block, FOUND)
    # Each pair at 0, for languages without kept terms.
    names = totals.select("lang", F.explode("totals.source").alias("source"), F.col("totals.source").alias("others"))
    pairs = names.select("lang", "source", F.lit("pair").alias("part"), F.explode("others").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = values.unionByName(pairs.where("source <> item")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by 1, 2 having count(distinct row_id) >= 10),
v as (select lang, count(*) as v from k group by 1),
g as (select distinct lang, source from d),
o as (select lang, source, term, count(*) as n from t group by 1, 2, 3),
c as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n from g join k on g.lang = k.lang
  left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // ((sum(n) over (partition by lang, source)) + 2 * v) as p
  from c join v using (lang)),
l as (select lang, term, sum(n) as n from c group by 1, 2),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // ((sum(n) over (partition by lang)) + 2 * v) as q from l join v using (lang)),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from p join q using (lang, term) where n > 0 and p > q),
n as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r)
select lang, source, part, item, value, rank from n where part = 'pair' or rank <= 10
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
