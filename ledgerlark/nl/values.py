"""Values of large dimensions, such as customer names, found by an index that is joined, not looped over.

The index has a row for each value and each string that is left when up to EDITS letters are deleted from it. Two words
at a distance of EDITS or less share such a string, so a word's own deletions, joined with the index, find all candidates; their
distance is then computed. The index is a table: built once, bucketed by the deletion, and grown with the dimension.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.spec import CATALOG, Catalog
from ledgerlark.sources.catalog import load

#: Letters that a misspelt value may be off by; shorter words than LEAST_LENGTH have to be right.
EDITS = 1
LEAST_LENGTH = 4
MOST_CANDIDATES = 20


def deletions(word: str, edits: int = EDITS) -> set[str]:
    """The word and what is left of it without up to so many letters."""
    edits = edits if len(word) >= LEAST_LENGTH else 0
    return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(edits + 1) for gone in combinations(range(len(word)), n)}


def _deletions(word: Column) -> Column:
    """The same of one letter, as an array."""
    place = F.sequence(F.lit(1), F.length(word))
    shorter = F.transform(place, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= LEAST_LENGTH, shorter).otherwise(F.array().cast("array<string>"))))


def open_dimensions(catalog: Catalog = CATALOG) -> list[str]:
    """Dimensions whose values the catalog does not list."""
    return [d.name for d in catalog.dimensions.values() if d.kind == "value" and not d.values]


def index_of(spark: SparkSession, sf_dir: str, catalog: Catalog = CATALOG) -> DataFrame:
    """(part, dimension, value): every value of the open dimensions under each of its deletions."""
    out = None
    for name in open_dimensions(catalog):
        d = catalog.dimensions[name]
        values = load(spark, sf_dir, d.table).select(F.lit(name).alias("dimension"), F.col(d.column).alias("value")).where("value is not null").distinct()
        out = values if out is None else out.union(values)
    return out.select(F.explode(_deletions(F.lower("value"))).alias("part"), "dimension", "value")


def save_index(spark: SparkSession, sf_dir: str, table: str, buckets: int = 64, catalog: Catalog = CATALOG) -> None:
    index_of(spark, sf_dir, catalog).write.mode("overwrite").bucketBy(buckets, "part").sortBy("part").saveAsTable(table)


def candidates(index: DataFrame, words: DataFrame) -> DataFrame:
    """(word, dimension, value, distance) for words(word): values at a distance of EDITS or less, exact ones at 0."""
    parts = words.select("word", F.explode(_deletions(F.lower("word"))).alias("part"))
    met = parts.join(index, "part").select("word", "dimension", "value").distinct()
    near = met.withColumn("distance", F.levenshtein(F.lower("word"), F.lower("value")).cast("long"))
    return near.where(F.col("distance") <= EDITS)


@dataclass(frozen=True)
class Found:
    word: str
    dimension: str
    value: str
    distance: int


class Values:
    """Looks words of a question up in an index; what it returns is bounded by the words of the question."""

    def __init__(self, index: DataFrame) -> None:
        self.index = index

    def find(self, words: Iterable[str]) -> list[Found]:
        """The best MOST_CANDIDATES values of each word, nearest first."""
        spark = self.index.sparkSession
        asked = sorted({part for w in words for part in deletions(w)})
        if not asked:
            return []
        table = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
        # The question's own strings reach the scan as a filter.
        near = candidates(self.index.where(F.col("part").isin(asked)), table)
        best = near.groupBy("word").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "dimension", "value"))), 1, MOST_CANDIDATES).alias("best"))
        return [Found(r["word"], b["dimension"], b["value"], b["distance"]) for r in best.orderBy("word").collect() for b in r["best"]]
