"""Connectors: files, catalog tables, JDBC, and a data source for databases with a Python driver."""

from __future__ import annotations

import contextlib
import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "jdbc")


def read(spark: SparkSession, format: str, path: str | None = None, schema: object = None, **options: str) -> DataFrame:
    """A batch read. File formats without types of their own need a schema, as inferring one scans everything."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    if schema is not None and format != "jdbc":
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table behind JDBC; with a key of whole numbers it is read by so many tasks, cut between the key's ends."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", table).load()
    ends = reader.option("query", f"select min({key}) as low, max({key}) as high from {table}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if ends[0] is None:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(partitions)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write(df: DataFrame, format: str, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def save_table(df: DataFrame, name: str, comment: str = "", bucket_by: tuple[int, str] | None = None, **properties: str) -> None:
    """A catalog table; bucketed by a join key it joins with its like without a shuffle."""
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
    writer.saveAsTable(name)
    spark = df.sparkSession
    if comment:
        spark.sql(f"comment on table {name} is '{comment.replace(chr(39), chr(39) * 2)}'")
    for key, value in properties.items():
        spark.sql(f"alter table {name} set tblproperties ('{key}' = '{value}')")


def quoted(name: str) -> str:
    """An identifier for SQL, whatever it holds."""
    return '"' + name.replace('"', '""') + '"'


class Span(InputPartition):
    """Keys after `after` and up to `upto`; None is no bound. Rows without a key are a span of their own."""

    def __init__(self, after: int | None, upto: int | None, without: bool = False) -> None:
        self.after, self.upto, self.without = after, upto, without

    def condition(self, key: str) -> tuple[str, list]:
        if self.without:
            return f"{quoted(key)} is null", []
        bounds = [(">", self.after), ("<=", self.upto)]
        told = [f"{quoted(key)} {op} ?" for op, x in bounds if x is not None] or [f"{quoted(key)} is not null"]
        return " and ".join(told), [x for _, x in bounds if x is not None]


class Connection:
    """A table behind any Python database driver (DB-API 2) whose parameters are `?`, such as sqlite3."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        missing = {"database", "table", "key"} - set(options)
        if missing:
            raise ValueError(f"the database connector needs {', '.join(sorted(missing))}")
        self.driver, self.database = options.get("driver", "sqlite3"), options["database"]
        self.table, self.key, self.columns = options["table"], options["key"], columns
        self.parts, self.fetch = int(options.get("partitions", "8")), int(options.get("fetch", "5000"))

    def rows(self, columns: str, condition: str, values: list) -> Iterator[tuple]:
        driver = importlib.import_module(self.driver)
        with contextlib.closing(driver.connect(self.database)) as connection:
            cursor = connection.cursor()
            cursor.execute(f"select {columns} from {quoted(self.table)} where {condition}", values)
            while found := cursor.fetchmany(self.fetch):
                yield from map(tuple, found)

    def read(self, span: Span, more: list[tuple[str, list]]) -> Iterator[tuple]:
        """The rows of a span that meet all further conditions."""
        conditions = [span.condition(self.key), *more]
        yield from self.rows(
            ", ".join(map(quoted, self.columns)), " and ".join(f"({c})" for c, _ in conditions), [v for _, vs in conditions for v in vs]
        )

    def limits(self) -> tuple[int | None, int | None, bool]:
        """The least and greatest key, and whether there are rows without one."""
        key = quoted(self.key)
        low, high = next(self.rows(f"min({key}), max({key})", "1 = 1", []))
        return low, high, any(True for _ in self.rows("1", f"{key} is null limit 1", []))


class DatabaseReader(DataSourceReader):
    def __init__(self, connection: Connection) -> None:
        self.connection, self.pushed = connection, []

    def partitions(self) -> list[Span]:
        low, high, without = self.connection.limits()
        if low is None:
            return [Span(None, None, without)]
        n = max(1, min(self.connection.parts, high - low + 1))
        cuts = [low - 1 + (high - low + 1) * i // n for i in range(n + 1)]
        # The first and the last are open: rows that come while the job runs are read once.
        spans = [Span(a if i else None, b if i < n - 1 else None) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return spans + [Span(None, None, True)] * without

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.connection.read(partition, self.pushed)


class PushingReader(DatabaseReader):
    """A reader that takes over filters; Spark accepts one only if its setting for that is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons with plain values; the rest is left to Spark."""
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and type(f) in ops and isinstance(f.value, (int, float, str)):
                self.pushed.append((f"{name} {ops[type(f)]} ?", [f.value]))
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.pushed.append((f"{name} is {'not ' * isinstance(f, IsNotNull)}null", []))
            elif name and isinstance(f, In) and f.value and all(isinstance(v, (int, float, str)) for v in f.value):
                self.pushed.append((f"{name} in ({', '.join('?' * len(f.value))})", list(f.value)))
            else:
                yield f


class DatabaseStream(DataSourceStreamReader):
    """New rows by growing key; a row whose key is not above those seen is not."""

    def __init__(self, connection: Connection) -> None:
        self.connection = connection

    def initialOffset(self) -> dict:
        low = self.connection.limits()[0]
        return {"upto": 0 if low is None else low - 1}

    def latestOffset(self) -> dict:
        high = self.connection.limits()[1]
        return {"upto": 0 if high is None else high}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = start["upto"], end["upto"]
        n = max(1, min(self.connection.parts, high - low))
        cuts = [low + (high - low) * i // n for i in range(n + 1)]
        return [Span(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.connection.read(partition, [])

    def commit(self, end: dict) -> None:
        pass


class Database(DataSource):
    """A table of a business system's database, read by many tasks: spark.read.format("database").schema(...)

    Options: database (what the driver connects to), table, key (a column of whole numbers that rows are dealt by), driver (a DB-API
    module, sqlite3 by default), partitions and fetch; pushdown, for which spark.sql.python.filterPushdown.enabled has to be on. Executors have to reach the database. As a stream it gives rows of
    greater and greater keys.
    """

    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> str:
        raise ValueError("the database connector needs a schema")

    def _connection(self, schema: StructType) -> Connection:
        return Connection(dict(self.options), schema.fieldNames())

    def reader(self, schema: StructType) -> DatabaseReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else DatabaseReader
        return kind(self._connection(schema))

    def streamReader(self, schema: StructType) -> DatabaseStream:
        return DatabaseStream(self._connection(schema))
