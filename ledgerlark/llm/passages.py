"""What the pipeline deletes besides the repeated units and lines of operator 3: later copies of passages, word by word.

Each word goes that stands in a run of RUN_WORDS words which occurred earlier, wherever in a line or sentence either
starts; white space does not count. So every maximal repeated run of that length or more goes to its last word.
Fingerprints are hashes of GRAM words that begin at an anchor: a word whose hash is divisible by SPARSE, or one that has
no such word within REACH = (RUN_WORDS - GRAM) / 2 words to either side. Whether a word is an anchor depends on its neighbourhood alone and any
2 * REACH + GRAM words hold a fingerprint. All fingerprints of a repeated run occur twice, so only the runs without any
that occurs once are written out and compared. A text that is all of an earlier document's goes whole and needs no runs of
its own. Runs and whole texts are told by two digests of 64 bits each.

A place is a span (at, n): n words from the word `at` on, counted over the whole text. Runs are counted and
joined to their first place only, so one that is in every document costs as many rows as it has occurrences. Rows of
equal doc_id and text are the same document; null doc_id sorts first; null or empty text has no spans.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.secrets import let
from ledgerlark.llm.shared import SPACE, cut, fresh_path, remove

#: A repeated run of so many words is always found. GRAM words make a fingerprint.
RUN_WORDS = 25
GRAM = 9
SPARSE = 6
#: As many documents as are broadcast at most.
FEW = 200_000
BLANK = " \t\n\x0b\f\r"


def release(spark: SparkSession) -> None:
    """Has the driver notice shuffles that only earlier, cut-off steps used, so that their files go."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def later(found: DataFrame) -> DataFrame:
    """The rows of found(print, run, doc_id, text_key, at, ..) of which the same digests have an earlier place."""
    place = F.struct("doc_id", "text_key", "at")
    firsts = found.groupBy("print", "run").agg(F.min(place).alias("first"), F.count("*").alias("seen"))
    # Cut off before it is joined, so that joins with a very common line can be split.
    again = cut(firsts.where("seen > 1").select(F.col("print").alias("p"), F.col("run").alias("r"), "first"))
    met = found.join(again, (F.col("print") == F.col("p")) & (F.col("run") == F.col("r")))
    return met.where(~place.eqNullSafe(F.col("first")))


def word_hashes(text: Column) -> Column:
    words = F.split(F.trim(text, F.lit(BLANK)), f"[{SPACE}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprints(hashes: Column, run_words: int, gram: int) -> Column:
    """(at, print) for each fingerprint; there are run_words hashes or more."""
    reach = (run_words - gram) // 2
    last = F.size(hashes) - gram

    def anchors(marked: Column) -> Column:
        """The marked places and those that are further than reach from any; either end counts as marked."""

        def gaps(ends: Column) -> Column:
            return F.transform(
                ends,
                lambda p, i: F.when(
                    F.get(ends, i + 1) - p > 2 * reach + 1, F.sequence(p + (reach + 1), F.get(ends, i + 1) - (reach + 1))
                ),
            )

        ends = F.concat(F.array(F.lit(-1)), marked, F.array(last + 1))
        return F.concat(marked, F.flatten(F.array_compact(let(ends, gaps))))

    marked = F.filter(F.sequence(F.lit(0), last), lambda i: F.pmod(F.get(hashes, i), F.lit(SPARSE)) == 0)
    return F.transform(
        let(marked, anchors),
        lambda p: F.struct(p.alias("at"), F.xxhash64(F.slice(hashes, p + 1, F.lit(gram))).alias("print")),
    )


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, span): spans that cover each word in a run of run_words words that occurred earlier."""
    spark, width = docs.sparkSession, run_words - gram + 1
    texts = docs.withColumns({"text_key": F.xxhash64("text"), "text_key2": F.xxhash64(F.lit(7), F.col("text"))})
    path = fresh_path(spark, "passages")
    seen = let(
        word_hashes(F.col("text")),
        lambda h: F.when(
            F.size(h) >= run_words,
            F.struct(F.size(h).alias("n"), fingerprints(h, run_words, gram).alias("x")),
        ),
    )
    texts.select("doc_id", "text_key", "text_key2", seen.alias("s")).where("s is not null").select(
        "doc_id", "text_key", "text_key2", F.xxhash64("doc_id", "text_key").alias("doc"), "s.*"
    ).write.parquet(path)
    found = spark.read.parquet(path)

    whole = found.select(
        "doc_id", "text_key", F.lit(0).alias("at"), "n", F.col("text_key2").alias("print"), F.col("text_key").alias("run")
    )
    copies = cut(later(whole).select("doc_id", "text_key", "at", "n").distinct())
    # Later copies need no runs of their own, and what they share with others their original shares as well.
    gone = copies.select(F.xxhash64("doc_id", "text_key").alias("d"))
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    own = found.join(gone, F.col("doc") == F.col("d"), "left_anti")
    prints = own.select("doc", F.explode("x").alias("x")).select("doc", "x.*")
    shared = cut(prints.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select(F.col("print").alias("p")))
    release(spark)
    mine = prints.join(shared, F.col("print") == F.col("p"), "left_semi").select(F.col("doc").alias("d"), "at")
    mine = cut(mine.groupBy("d").agg(F.collect_set("at").alias("ats")))
    del prints, shared
    release(spark)
    every = own.select("doc", "n", F.col("x.at").alias("all"))
    alone = F.array_sort(F.concat(F.array_except("all", "ats"), F.array(F.lit(-1), F.col("n") - (gram - 1))))

    def between(alone: Column) -> Column:
        """Where runs begin that hold no fingerprint that stands alone; either end of the text counts as such."""
        return F.transform(
            alone,
            lambda b, i: F.when(F.get(alone, i + 1) - b > width, F.sequence(b + 1, F.get(alone, i + 1) - width)),
        )

    around = F.flatten(F.array_compact(let(alone, between)))
    mine = every.join(mine, F.col("doc") == F.col("d")).select("doc", around.alias("around"))
    mine = cut(mine.where(F.size("around") > 0))
    del every, own, found, whole
    remove(spark, path)
    release(spark)
    runs = let(
        word_hashes(F.col("text")),
        lambda h: F.transform(
            F.col("around"),
            lambda i: let(
                F.slice(h, i + 1, F.lit(run_words)),
                lambda r: F.struct(i.alias("at"), F.xxhash64(r).alias("run"), F.xxhash64(F.lit(7), r).alias("print")),
            ),
        ),
    )
    near = texts.join(mine, F.xxhash64("doc_id", "text_key") == F.col("doc"))
    path = fresh_path(spark, "runs")
    near.select("doc_id", "text_key", F.explode(runs).alias("x")).select("doc_id", "text_key", "x.*").write.parquet(path)
    del near, mine
    rows = spark.read.parquet(path)
    release(spark)
    again = later(rows).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    again = cut(again)
    del rows
    remove(spark, path)
    release(spark)
    # Starts that follow one another make one span, from the first of them to the end of the last one's run.
    neighbours = lambda step: F.filter(
        F.transform("ats", lambda p, i: F.struct(p.alias("p"), F.get(F.col("ats"), i + step).alias("q"))),
        lambda x: ~x["q"].eqNullSafe(x["p"] + step),
    )
    merged = F.zip_with(
        neighbours(-1),
        neighbours(1),
        lambda a, b: F.struct(a["p"].alias("at"), (b["p"] - a["p"] + run_words).alias("n")),
    )
    spans = again.select("doc_id", "text_key", F.explode(merged).alias("span"))
    return spans.unionByName(copies.select("doc_id", "text_key", F.struct("at", "n").alias("span")))
