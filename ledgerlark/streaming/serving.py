"""Serving tables: what a stream keeps current, in versions that a reader sees whole or not at all.

Rows are kept in buckets of their key. A batch writes new versions of the buckets that it touches, beside the old ones,
and then a manifest of all buckets and the version each is at; the manifest, one small file, is the pointer that is
swapped last. A crash before that leaves the old manifest; the batch that comes again replaces what was begun.
A reader takes the newest manifest and reads just the folders that it names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, at long, version long"


class ServingTable:
    """A table under path with the given schema and keys. buckets stays as it was when the table was begun.

    Null key values are values. Batches are numbered from 0 on, and a number stands for the same rows when it comes again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> None:
        if {"bucket", "version"} & set(schema.fieldNames()):
            raise ValueError("a serving table has no columns named bucket or version")
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version (of those before a batch), -1 if there is none, and the version of each bucket."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return -1, {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        last = rows.agg(F.max("version").alias("v")).first()["v"]
        if last is None:
            return -1, {}
        # A row for each bucket.
        return last, {r["bucket"]: r["at"] for r in rows.where(F.col("version") == last).collect()}

    def _point(self, number: int, at: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(at.items()), "bucket int, at long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")

    def _stored(self, at: dict[int, int]) -> DataFrame:
        """The rows of these buckets at these versions; no other folder is read."""
        if not at:
            return self.spark.createDataFrame([], self.schema)
        placed = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
        by_version: dict[int, list[int]] = {}
        for bucket, version in at.items():
            by_version.setdefault(version, []).append(bucket)
        here = reduce(lambda a, b: a | b, ((F.col("version") == v) & F.col("bucket").isin(b) for v, b in by_version.items()))
        rows = self.spark.read.schema(placed).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/version={v}" for v in by_version))
        return rows.where(here).select(*self.schema.fieldNames())

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its newest version, or of one that has not been cleared away."""
        return self._stored(self.manifest(None if version is None else version + 1)[1])

    def _write(self, rows: DataFrame, number: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")

    def upsert(self, batch: DataFrame, number: int, order: list[Column] | None = None) -> None:
        """Puts the batch's rows in place of those with the same key; of several in a batch the first by order stays.

        Only the buckets that the batch's keys fall into are read and written. A batch that was finished is left alone.
        """
        if self.manifest()[0] >= number:
            return
        touched = [r["b"] for r in batch.select(self._bucket().alias("b")).distinct().collect()]
        _, at = self.manifest(before=number)
        if touched:
            old = self._stored({b: v for b, v in at.items() if b in set(touched)}).withColumn("_new", F.lit(0))
            both = old.unionByName(batch.select(*self.schema.fieldNames()).withColumn("_new", F.lit(1)))
            first = Window.partitionBy(*self.keys).orderBy(F.col("_new").desc(), *(order or []))
            kept = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new")
            self._write(kept, number)
        self._point(number, at | dict.fromkeys(touched, number))

    def replace(self, batch: DataFrame, number: int) -> None:
        """Makes the batch the whole table: the sink of complete mode."""
        if self.manifest()[0] >= number:
            return
        self._write(batch.select(*self.schema.fieldNames()), number)
        self._point(number, dict.fromkeys(range(self.buckets), number))

    def vacuum(self) -> list[int]:
        """Deletes data versions that the newest manifest does not name, and older manifests; returns the versions."""
        last, at = self.manifest()
        if last < 0:
            return []
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for kind, used in (("data", set(at.values())), ("manifest", {last})):
            for status in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")):
                name = status.getPath().getName()
                number = int(name.partition("=")[2]) if name.startswith("version=") else None
                if number is not None and number not in used and number < last:
                    fs.delete(status.getPath(), True)
                    gone += [number] if kind == "data" else []
        return sorted(gone)


def upserts(table: ServingTable, order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the last row of each key, for update mode or for change feeds."""
    return lambda batch, number: table.upsert(batch, number, order)


def replaces(table: ServingTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for complete mode."""
    return lambda batch, number: table.replace(batch, number)
