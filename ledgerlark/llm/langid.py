"""Operator 9, language ID by string kernels.

A text is the set of its n-grams of one to three UTF-8 bytes, lower-cased and hashed into fixed ranges (BINS). The
blended-spectrum presence kernel of two texts is the weighted number of n-grams that both have, over the geometric
mean of what each has. LANDMARKS training texts serve as Nystroem landmarks: kernel values against them, whitened by
the inverse root of the landmarks' own kernel matrix, are the features on which a kernel ridge regression is fitted
for each language against the rest. As the kernel is an inner product of presence vectors, landmarks, whitening and
ridge weights multiply out to one matrix of bins x languages, by which batches of texts are scored.

Fitting uses a bounded sample: for each language the SAMPLE labelled rows of least hash, fewer if that were more than
MOST_ROWS in all. Only their bit sets reach the driver, about 1 kB a row, where they become at most 270 MB of floats. Every whole text is scored; nothing is cut off.

Edge cases: null text, or text without a letter, is `und` with score 0; so is everything if nothing could be
learned; null lang rows are predicted but never learned from; null doc_id counts as not held out (its crc32 is
unknown); a text of letters unlike all others still gets the best language, with a low score; repeated rows get
equal predictions; more than MOST_LANGUAGES labels are an error; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.shared import table

#: Bins for n-grams of 1, 2 and 3 bytes and the weight of each kind.
BINS = (256, 2048, 6144)
BLEND = (0.5, 1.0, 1.5)
SAMPLE = 300
#: Rows fitted on in all; with more languages each has fewer. As vectors of floats they take 8448 * 4 bytes each, 270 MB.
MOST_ROWS = 8000
MOST_LANGUAGES = 2000
LANDMARKS = 128
#: Texts with fewer different n-grams are too short to be told from an unknown language.
LEAST_BINS = 300
RIDGE = 1e-2
SHARPNESS = 6.0
BATCH = 256


def presence(text: str) -> np.ndarray:
    """Which bins a text has, as booleans."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    seen = np.zeros(sum(BINS), bool)
    for at in range(0, len(data), 1 << 20):
        a = data[at : at + (1 << 20) + 2].astype(np.uint32)
        seen[a] = True
        pair = a[:-1] * np.uint32(257) + a[1:]
        seen[BINS[0] + (pair * np.uint32(2654435761) >> np.uint32(21))] = True
        triple = pair[:-1] * np.uint32(263) + a[2:]
        seen[BINS[0] + BINS[1] + (triple * np.uint32(2246822519) >> np.uint32(16)) % np.uint32(BINS[2])] = True
    return seen


def weights() -> np.ndarray:
    return np.concatenate([np.full(n, w, np.float32) for n, w in zip(BINS, BLEND, strict=True)])


def vectors(seen: np.ndarray) -> np.ndarray:
    """Rows whose inner products are kernel values."""
    v = seen * np.sqrt(weights())
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-9)


class Model:
    def __init__(self, langs: list[str], scorer: np.ndarray) -> None:
        self.langs, self.scorer = langs, scorer

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether each text fits its language (True if nothing could be learned).

        A text with enough n-grams fits none if each language's regression puts it with the rest (below 0 of -1 to 1).
        With two languages one of both always has it, so nothing is rejected.
        """
        langs, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [not self.langs] * len(texts)
        # A million letter-free characters should not be walked before the kernel finds no use for them.
        usable = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)] if self.langs else []
        for at in range(0, len(usable), BATCH):
            part = usable[at : at + BATCH]
            seen = np.stack([presence(texts[i]) for i in part])
            raw = vectors(seen) @ self.scorer
            fit = (raw.max(axis=1) >= 0) | (seen.sum(axis=1) < LEAST_BINS) | (len(self.langs) < 3)
            best = raw.argmax(axis=1)
            odds = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            sure = odds.max(axis=1) / odds.sum(axis=1)
            for i, b, s, f in zip(part, best, sure, fit, strict=True):
                langs[i], scores[i], fits[i] = self.langs[b], float(s), bool(f)
        return langs, scores, fits


def fit(labels: list[str], seen: np.ndarray) -> Model:
    """Ridge regression on Nystroem features; rows in any order that is the same on each run."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((sum(BINS), 0), np.float32))
    x = vectors(seen)
    y = np.array([[1.0 if a == b else -1.0 for b in langs] for a in labels])
    # Landmarks are taken from the languages in turn.
    rank = pd.Series(labels).groupby(np.array(labels)).cumcount().to_numpy()
    marks = x[np.argsort(rank, kind="stable")[:LANDMARKS]].astype(np.float64)
    values, basis = np.linalg.eigh(marks @ marks.T)
    whiten = basis / np.sqrt(np.maximum(values, 1e-6)) @ basis.T
    z = x @ (marks.T @ whiten)
    each = 1.0 / np.array([labels.count(a) for a in labels])  # languages count alike
    fitted = np.linalg.solve(z.T @ (z * each[:, None]) + RIDGE * np.eye(z.shape[1]), z.T @ (y * each[:, None]))
    return Model(langs, (marks.T @ whiten @ fitted).astype(np.float32))


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows of docs(doc_id, text, lang) that have a label and a text with a letter."""
    # Null or repeated doc_ids are told apart by text and by their place in the input, so a language has no more than
    # `sample` rows whatever repeats.
    tie = F.struct(
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang")).alias("id"),
        F.xxhash64("text").alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    usable = docs.select("lang", "text", tie.alias("order")).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    labels = docs.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if labels > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels are no set of languages")
    sample = max(1, min(sample, MOST_ROWS // max(1, labels)))
    ranked = usable.select("lang", "order").withColumn(
        "n", F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    )
    ends = ranked.where(F.col("n") <= sample).groupBy("lang").agg(F.max("order").alias("end"))
    # One row for each language; texts stay where they are.
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends.collect(), ends.schema))

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.packbits(presence(t)).tobytes())

    chosen = usable.join(
        ends.withColumnRenamed("lang", "of"), (F.col("lang") == F.col("of")) & (F.col("order") <= F.col("end"))
    ).select("lang", F.col("order.id").alias("order"), bits("text").alias("bits"))
    rows = sorted(map(tuple, chosen.collect()))
    seen = [np.unpackbits(np.frombuffer(r[2], np.uint8))[: sum(BINS)].astype(bool) for r in rows]
    by_order = sorted(range(len(rows)), key=lambda i: rows[i][1:])
    return fit([rows[i][0] for i in by_order], np.array([seen[i] for i in by_order]).reshape(-1, sum(BINS)))


def predictions(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and fits."""

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, fits = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "fits": fits})

    return of(text)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs(doc_id, text, lang)."""
    split = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = learned(split.where(~F.col("held_out")))
    return split.select("doc_id", "held_out", predictions(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
