"""Operator 12, toxicity by weak supervision.

Lexicons. From a bounded sample of labelled rows (TOXIC_ROWS and CLEAN_ROWS, about as many are drawn by hash; all if there
are fewer) every word and every word stem of three to seven letters is counted in toxic and in clean documents. Those
that tell toxic documents best, by likelihood ratio and odds, make the lexicons: words, and stems that count only when a
document has several of them. At most UNITS of each kind are kept.

Voters. VOTERS look at a whole text: hits in the lexicons at several thresholds, their density, words spelled with digits
and signs, and patterns such as shouting. Each votes or doesn't, so a document's votes are an integer of 16 bits, and how
often each occurs with label 1, 0 or none, over all documents that are not held out, is all that the label model needs:
at most 3 * 2^16 counts, whatever the size of the corpus.

Label model. Whether a document is toxic is hidden. Given that, votes depend on each other along a tree (of greatest
mutual information within the classes), and the label is one more voter with errors of its own. Expectation-maximisation
estimates the share of toxic documents, each voter's accuracy, the tree and its correlations, and the label's errors.

Classifier. A logistic regression on hits by unit, by lexicon and by density is fitted to the posterior labels of the
sample, weighted back to the shares of the corpus; it scores every text, in one pass and without a shuffle.

Edge cases: null or empty texts are scored as texts without hits; null doc_id is not held out and has no label; without
a toxic or without a clean labelled row nothing is learned, and the score is the toxic share of those rows, or 0;
several label rows of a document count as toxic if one says so; repeated rows get equal scores; texts are read whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.divergence import pieces, terms_of
from ledgerlark.llm.langid import held_out
from ledgerlark.llm.shared import fresh_path, remove, table

TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
UNITS = 200
STEMS = (3, 4, 5, 6, 7)
LEAST_ODDS = 1.5  # natural logarithm, between the shares of toxic and clean documents
LEAST_RATIO = 10.0  # of the likelihood test, at least; more with more candidates
ROUNDS = 60  # of expectation-maximisation
LABEL_ERROR = 0.02  # at its start
RIDGE = 0.3
VOTERS = 16
#: Digits and signs that stand for letters.
SIGNS = bytes.maketrans(b"013457@$!", b"oieastasi")
SAMPLE_PARTS = 16


def units_of(word: str) -> list[str]:
    """The word and its stems; a stem ends in a hyphen, which no word has."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).lower()
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def document_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of all units that occur, and (row, unit, hits) of each that a text has."""
    terms, row = terms_of(texts)
    coded = terms.dictionary_encode()
    names: dict[str, int] = {}
    of_word = [[names.setdefault(u, len(names)) for u in units_of(w)] for w in coded.dictionary.to_pylist()]
    return list(names), *_hits(row, coded.indices.to_numpy(), of_word, max(1, len(names)))


def _hits(row: np.ndarray, word: np.ndarray, of_word: list[list[int]], units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit, hits) from each token's row and word, and each word's units."""
    sizes = np.array([len(x) for x in of_word], np.int64)
    flat = np.array([u for x in of_word for u in x], np.int64)
    begins = np.cumsum(sizes) - sizes
    own = sizes[word] if len(sizes) else np.zeros(0, np.int64)
    token = np.repeat(np.arange(len(word)), own)
    place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    unit = flat[begins[word[token]] + place] if len(token) else np.zeros(0, np.int64)
    cells, n = np.unique(row[token] * units + unit, return_counts=True)
    return cells // units, cells % units, n


@dataclass(frozen=True)
class Lexicon:
    """Units with their places, words first."""

    units: dict[str, int]
    words: int

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, unit, hits) of the lexicon's units in the texts, and each text's number of words."""
        terms, row = terms_of(texts)
        coded = terms.dictionary_encode()
        of_word = [[self.units[u] for u in units_of(w) if u in self.units] for w in coded.dictionary.to_pylist()]
        size = np.bincount(row, minlength=len(texts))
        return *_hits(row, coded.indices.to_numpy(), of_word, max(1, len(self.units))), size


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[bool, int]]:
    """(text, toxic, weight): the sample of labelled rows that are not held out; and how many such labels there are."""
    known = known_labels(labels)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {t: min(1.0, n / max(1, counts.get(t, 0))) for t, n in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))}
    draw = F.pmod(F.xxhash64("labelled", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic"), shares[True]).otherwise(shares[False])
    # About TOXIC_ROWS + CLEAN_ROWS rows of a long and two small values.
    drawn = F.broadcast(known.where(draw < share).withColumn("weight", 1 / share))
    rows = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("labelled"))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "weight"), counts


def known_labels(labels: DataFrame) -> DataFrame:
    """(labelled, toxic) of documents that may be learned from."""
    told = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 5, 0))
    return told.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("toxic") == 1).alias("toxic"))


def lexicon_of(sample: DataFrame) -> Lexicon:
    """The units that tell toxic documents from clean ones best: words by presence, stems by two hits or more."""
    schema = pa.schema([("unit", pa.string()), *((c, pa.int64()) for c in ("a1", "a2", "b1", "b2"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b)):
            names, row, unit, n = document_units(piece["text"])
            toxic = piece["toxic"].to_numpy(zero_copy_only=False).astype(bool)[row]
            sums = [np.bincount(unit[who & (n >= k)], minlength=len(names)) for who in (toxic, ~toxic) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(s) for s in sums)], schema=schema)

    size = sample.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).first()
    found = sample.select("text", "toxic").mapInArrow(count, "unit string, a1 long, a2 long, b1 long, b2 long")
    sums = found.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("a1", "a2", "b1", "b2")))
    is_stem = F.col("unit").endswith("-")
    a, b = (F.when(is_stem, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).cast("double") for x in "ab")
    used = sums.select("unit", is_stem.alias("stem"), a.alias("a"), b.alias("b")).where("a >= 3")
    candidates = used.agg(F.count("*").alias("n")).first()["n"]
    share = size["t"] / max(1, size["t"] + size["c"])
    n = F.col("a") + F.col("b")
    # Of the documents that have the unit, more are toxic than among all.
    term = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    ratio = 2 * (term(F.col("a"), share) + term(F.col("b"), 1 - share))
    odds = F.log((F.col("a") + 0.5) / (size["t"] + 1)) - F.log((F.col("b") + 0.5) / (size["c"] + 1))
    least = max(LEAST_RATIO, 2 * math.log(max(1, candidates)))
    good = used.select("unit", "stem", ratio.alias("ratio"), odds.alias("odds")).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= least))
    kept = []
    for stem in (False, True):
        best = good.where(F.col("stem") == stem).orderBy(F.col("ratio").desc(), "unit").limit(UNITS)
        kept.append([r["unit"] for r in best.collect()])
    return Lexicon({u: i for i, u in enumerate(kept[0] + kept[1])}, len(kept[0]))


@dataclass(frozen=True)
class Seen:
    """What voters and the classifier look at, for a batch of texts."""

    row: np.ndarray
    unit: np.ndarray
    hits: np.ndarray
    dense: np.ndarray  # by text: see DENSE
    votes: np.ndarray


DENSE = 8


def look(texts: pa.Array, lexicon: Lexicon) -> Seen:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    row, unit, hits, words = lexicon.hits(texts)
    is_word = unit < lexicon.words
    longest = np.array([len(u) - 1 for u in lexicon.units], np.int64)
    long_stem = ~is_word & (longest[unit] >= 6) if len(unit) else is_word

    def most(mask: np.ndarray) -> np.ndarray:
        """Hits of the unit with most, and of all, by text."""
        out = np.zeros(n, np.int64)
        np.maximum.at(out, row[mask], hits[mask])
        return out

    total_words = np.bincount(row[is_word], hits[is_word], n)
    distinct = np.bincount(row[is_word], minlength=n)
    stems, long_stems = most(~is_word), most(long_stem)
    every = np.maximum(total_words, stems)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]

    def number(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of)))
        return sums[ends[1:]] - sums[ends[:-1]]

    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    capitals = number((raw >= 65) & (raw <= 90))
    called = number(raw == 33) + number(raw == 63)
    signs = number(np.isin(raw, np.frombuffer(b"#$%&*|@", np.uint8)))
    spelled = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw.tobytes().translate(SIGNS)))
    row2, unit2, hits2, _ = lexicon.hits(spelled)
    hidden = np.maximum(0, np.bincount(row2[unit2 < lexicon.words], hits2[unit2 < lexicon.words], n) - total_words)
    length = np.maximum(1, words)
    votes = (
        total_words >= 1,
        total_words >= 2,
        total_words >= 3,
        distinct >= 2,
        stems >= 1,
        stems >= 2,
        stems >= 3,
        long_stems >= 2,
        long_stems >= 3,
        every * 200 >= length,
        (every == 0),
        (every <= 1) & (words > 300),
        hidden >= 1,
        capitals * 10 > number(letters) * 3,
        called * 50 > length,
        signs * 20 > length,
    )
    packed = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    log = lambda x: np.log1p(np.minimum(x, 20)) / 3
    dense = np.stack(
        [log(total_words), log(distinct), log(stems), log(long_stems), log(hidden), np.minimum(1, every * 50 / length), every >= 2, every >= 3], axis=1
    )
    return Seen(row, unit, hits, dense.astype(np.float64), packed if n else np.zeros(0, np.int64))


@dataclass
class LabelModel:
    """P(toxic), a tree of P(vote | parent's vote, toxic), and P(label | toxic); votes are bits of an integer."""

    prior: float
    parent: list[int]
    tables: np.ndarray  # [voter, class, parent's vote]: chance that it votes
    label: np.ndarray  # [class]: chance that the label is 1

    def odds(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Log odds of toxic; label is 1, 0 or -1 for none."""
        out = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent):
            x = votes >> j & 1
            above = (votes >> up & 1) if up >= 0 else np.zeros_like(x)
            p, q = self.tables[j, 1, above], self.tables[j, 0, above]
            out += np.where(x == 1, np.log(p / q), np.log((1 - p) / (1 - q)))
        p, q = self.label[1], self.label[0]
        return out + np.where(label == 1, math.log(p / q), np.where(label == 0, math.log((1 - p) / (1 - q)), 0.0))


def tree_of(pairs: np.ndarray) -> list[int]:
    """Parents of the spanning tree with most mutual information given the class; pairs[class, i, j, x, y] are weights."""
    k = pairs.shape[1]
    joint = pairs / np.maximum(pairs.sum(axis=(3, 4), keepdims=True), 1e-9)
    left, right = joint.sum(axis=4, keepdims=True), joint.sum(axis=3, keepdims=True)
    told = np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(left * right, 1e-300)), 0).sum(axis=(3, 4))
    weight = pairs[:, 0, 0].sum(axis=(1, 2))
    information = np.tensordot(weight / max(weight.sum(), 1e-9), told, 1)
    parent, inside = [-1] * k, [0]
    while len(inside) < k:
        i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda e: (information[e], -e[0], -e[1]))
        parent[j] = i
        inside.append(j)
    return parent


def fit_votes(votes: np.ndarray, label: np.ndarray, count: np.ndarray, voters: int = VOTERS) -> LabelModel:
    """Expectation-maximisation over counted votes and labels, from the labelled ones on."""
    bits = (votes[:, None] >> np.arange(voters) & 1).astype(float)
    both = np.concatenate((1 - bits, bits), axis=1)
    sure = np.where(label == 1, 1 - LABEL_ERROR, LABEL_ERROR)
    toxic, weight = sure, np.where(label >= 0, count, 0.0)
    model = None
    for step in range(ROUNDS):
        by_class = [weight * (1 - toxic), weight * toxic]
        # [class, i, j, x, y]
        pairs = np.stack([(both.T @ (both * w[:, None])).reshape(2, voters, 2, voters).transpose(1, 3, 0, 2) for w in by_class])
        parent = tree_of(pairs) if step < ROUNDS // 2 or model is None else model.parent
        tables = np.full((voters, 2, 2), 0.5)
        for j, up in enumerate(parent):
            cell = pairs[:, j, up] if up >= 0 else np.repeat(pairs[:, j, j].sum(axis=2, keepdims=True), 2, axis=2)
            rate = pairs[:, j, j, 1, 1] / np.maximum(pairs[:, j, j].sum(axis=(1, 2)), 1e-9)
            # Few documents behind a cell lean on the voter's own rate.
            tables[j] = (cell[:, 1] + 2 * rate[:, None] + 0.02) / (cell.sum(axis=1) + 2.04)
        labelled = label >= 0
        ones = [(w * (label == 1)).sum() for w in by_class]
        told = [(w * labelled).sum() for w in by_class]
        rates = np.array([(o + LABEL_ERROR * (1 + 48 * c)) / (t + 1 + 48 * LABEL_ERROR) for c, (o, t) in enumerate(zip(ones, told, strict=True))])
        rates = np.array([min(rates[0], 0.2), max(rates[1], 0.8)])
        prior = float(np.clip(by_class[1].sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4))
        model = LabelModel(prior, parent, np.clip(tables, 1e-4, 1 - 1e-4), np.clip(rates, 1e-3, 1 - 1e-3))
        weight = count.astype(float)
        toxic = 1 / (1 + np.exp(-np.clip(model.odds(votes, label), -500, 500)))
    return model


@dataclass(frozen=True)
class Classifier:
    lexicon: Lexicon
    units: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        seen = look(texts, self.lexicon)
        odds = self.bias + seen.dense @ self.dense
        if len(self.units):
            odds += np.bincount(seen.row, np.minimum(seen.hits, 3) / 3 * self.units[seen.unit], len(odds))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps, with a ridge; the bias is free."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], RIDGE)
    ridge[-1] = 1e-6
    weight = weight / weight.mean()

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + ridge * w
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-7 * abs(now):
            break
    return w[:-1], float(w[-1])


def counted_votes(docs: DataFrame, labels: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(votes, label, n) over all documents that are not held out: at most 3 * 2^VOTERS rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.int32())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b)):
            votes = look(piece["text"], lexicon).votes
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(votes, pa.int32())], schema=schema)

    own = docs.where(~held_out(F.col("doc_id"), 5, 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = own.mapInArrow(vote, "doc_id long, votes int").join(known_labels(labels), F.col("doc_id") == F.col("labelled"), "left")
    return voted.groupBy("votes", F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))


def learned(docs: DataFrame, labels: DataFrame) -> Classifier | float:
    """A classifier, or the score of all if there is nothing to learn from."""
    spark = docs.sparkSession
    rows, counts = sampled(docs, labels)
    if not counts.get(True) or not counts.get(False):
        return 1.0 if counts.get(True) else 0.0
    path = fresh_path(spark, "toxicity")
    rows.repartition(SAMPLE_PARTS).write.parquet(path)
    sample = spark.read.parquet(path)
    lexicon = lexicon_of(sample)
    votes = counted_votes(docs, labels, lexicon).toPandas()
    model = fit_votes(votes["votes"].to_numpy(np.int64), votes["label"].to_numpy(), votes["n"].to_numpy())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b)):
            seen = look(piece["text"], lexicon)
            ends = np.searchsorted(seen.row, np.arange(piece.num_rows + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            dense = pa.array(list(seen.dense), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [lists(seen.unit, pa.int32()), lists(seen.hits, pa.int32()), dense, pa.array(seen.votes, pa.int32()), piece["toxic"], piece["weight"]],
                ["unit", "hits", "dense", "votes", "toxic", "weight"],
            )

    # A bounded number of rows, with the lexicon's units only.
    told = sample.mapInArrow(features, "unit array<int>, hits array<int>, dense array<double>, votes int, toxic boolean, weight double").toPandas()
    remove(spark, path)
    if told.empty:
        return counts[True] / (counts[True] + counts[False])
    told = told.iloc[np.lexsort((told["weight"], told["votes"]))]  # rows of equal votes are close to each other: sums hardly vary
    x = np.zeros((len(told), len(lexicon.units) + DENSE))
    for i, (unit, hits) in enumerate(zip(told["unit"], told["hits"], strict=True)):
        x[i, np.asarray(unit, np.int64)] = np.minimum(hits, 3) / 3
    x[:, len(lexicon.units) :] = np.stack(told["dense"].to_list())
    odds = model.odds(told["votes"].to_numpy(np.int64), told["toxic"].to_numpy().astype(np.int64))
    w, bias = fit_linear(x, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), told["weight"].to_numpy())
    return Classifier(lexicon, w[: len(lexicon.units)], w[len(lexicon.units) :], bias)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text), learned from labels(doc_id, toxic)."""
    model = learned(docs, labels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b)):
            p = model.score(piece["text"]) if isinstance(model, Classifier) else np.full(piece.num_rows, model)
            said = pa.array((p >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), piece["held_out"], pa.array(p), said], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out")).mapInArrow(of, SCORED)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
