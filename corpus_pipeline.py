"""The training-corpus pipeline: language ID, line dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import langid, linededup, mixing, packing, similar
from ledgerlark.llm.shared import WORD, fresh_path, remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, and those that fit no language that can be learned here.

    Null text goes; short texts with letters stay, as do all if nothing can be learned; repeated rows are judged alike; an
    empty table stays empty. What fits is said by the fitted regressions: a long text that each of three or more of them
    puts with the rest goes.
    """
    model = langid.learned(docs.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id"))))
    guess = "prediction"
    while guess in docs.columns:
        guess += "_"
    judged = docs.withColumn(guess, langid.predictions(F.col("text"), model))
    return judged.where(F.col("text").rlike(r"\p{L}") & F.col(guess)["fits"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated lines and runs; a document of which nothing is left goes.

    Null and empty texts stay as they are; of rows with equal doc_id and text all keep or lose the same words; null
    doc_id comes first in order; n_chars is counted anew; an empty table stays empty.
    """
    done = linededup.deduplicate_whole(docs)
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    cut_down = done.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    kept = cut_down.select(*columns, "text", F.length("text").cast("long").alias("n_chars"))
    return kept.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of exact and near copies.

    First by doc_id, null first; texts without words are one group, null text among them; of repeated rows one stays.
    """
    return similar.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for; a copy is a row.

    Documents without words are not needed for any target but may be taken; null source is a source.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or chunk of one, lies in what packed sequence; documents without words as items of 0 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has no fitted classifier and no such random draws; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one's is written; the last stays, as it is what is returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
