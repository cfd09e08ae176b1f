"""The three business systems and the tables that stand in for them, with explicit schemas.

Real schemas replace this mapping in one place; nothing else names a table of a system.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    fields = []
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
        "time": T.TimestampNTZType(),
    }
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


#: Fixed schemas of the tables.
SCHEMAS = {
    "region": _schema("r_regionkey int, r_name string"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _schema("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": _schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    "part": _schema(
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": _schema(
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate time, "
        "o_orderpriority string"
    ),
    "lineitem": _schema(
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate time"
    ),
    "events": _schema("event_id long, ts time, user_id long, event_type string, value double, props string"),
    "conversations": _schema("conv_id long, turn long, role string, text string"),
}


@dataclass(frozen=True)
class Source:
    """One upstream system: its tables and the column that tells how fresh it is."""

    name: str
    tables: tuple[str, ...]
    fresh_table: str
    fresh_column: str


SOURCES = {
    "erp": Source("erp", ("lineitem", "part", "supplier"), "lineitem", "l_shipdate"),
    "sales": Source("sales", ("customer", "orders", "nation", "region"), "orders", "o_orderdate"),
    "ops": Source("ops", ("events", "conversations"), "events", "ts"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its fixed schema, which spares the job that would infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, as_of): the latest event time of each system, from the footers of its files where they tell it."""
    rows = [(s.name, latest(spark, f"{sf_dir}/{s.fresh_table}.parquet", SCHEMAS[s.fresh_table], s.fresh_column)) for s in SOURCES.values()]
    return spark.createDataFrame(rows, "source string, as_of timestamp_ntz")


def latest(spark: SparkSession, path: str, schema: T.StructType, column: str) -> datetime.datetime | None:
    """The greatest value of a time column: one number of each row group's footer, or a scan where that can't be had.

    The Parquet reader answers max() from footers for integers, not for times, so the column is read as the integer
    that it is stored as. That is right if files hold microseconds and their columns stand in the schema's order; a row read
    both ways and the files' own schema tell whether they do.
    """
    # Settings of its own; tables, files and executors are the same.
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    whole = T.StructType([T.StructField(f.name, T.LongType() if f.name == column else f.dataType) for f in schema])
    as_is = spark.read.schema(schema).parquet(path)
    if own.read.parquet(path).columns == schema.fieldNames():
        told = own.read.schema(whole).parquet(path)
        top = told.agg(F.max(column).alias("x"))
        plan = top._jdf.queryExecution().executedPlan().toString() if hasattr(top, "_jdf") else ""
        one = as_is.where(F.col(column).isNotNull()).select(column).first()
        raw = told.where(F.col(column).isNotNull()).select(column).first()
        if f"max({column})" in plan and one is not None and _EPOCH + datetime.timedelta(microseconds=raw[0]) == one[0]:
            return _EPOCH + datetime.timedelta(microseconds=top.first()["x"])
    return as_is.agg(F.max(column).alias("x")).first()["x"]


_EPOCH = datetime.datetime(1970, 1, 1)
