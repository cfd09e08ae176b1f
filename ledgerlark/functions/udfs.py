"""The UDF surface: registration of scalar, aggregate and table functions, and SQL functions for metric formulas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.nl.ask import to_spec
from ledgerlark.plans.spec import QuerySpec


@F.pandas_udf(T.DoubleType())
def trimmed_mean(x: pd.Series) -> float:
    """The mean without the lowest and the highest tenth. An aggregate; a group has to fit its task."""
    cut = len(x) // 10
    return float(x.sort_values().iloc[cut : len(x) - cut].mean()) if len(x) else float("nan")


@F.pandas_udf(T.StringType())
def title_case(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x.str.title()


@F.udtf(returnType=T.StructType([T.StructField("slot", T.StringType()), T.StructField("value", T.StringType())]))
class Explain:
    """select * from explain_question('...'): the slots of a question's spec, one row each."""

    def eval(self, question: str) -> Iterator[tuple[str, str]]:
        spec = to_spec(question)
        if not isinstance(spec, QuerySpec):
            yield type(spec).__name__, getattr(spec, "reason", getattr(spec, "question", ""))
            return
        for m in spec.metrics:
            yield "metric", m
        for b in spec.by:
            yield "by", b
        for f in spec.where:
            yield "where", f"{f.dimension} {f.op} {f.value}"


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to SQL. Formulas are SQL functions, which the optimiser sees through."""
    spark.udf.register("trimmed_mean", trimmed_mean)
    spark.udf.register("title_case", title_case)
    spark.udtf.register("explain_question", Explain)
    spark.sql(
        "create or replace temporary function net_price(price double, discount double) returns decimal(38,4) "
        "return cast(price as decimal(12,2)) * cast(1 - cast(discount as decimal(4,2)) as decimal(4,2))"
    )


def grouped(df: DataFrame, by: list[str], fn: object, schema: str) -> DataFrame:
    """applyInPandas by key; for groups that are known to fit a task."""
    return df.groupBy(*by).applyInPandas(fn, schema)


__all__ = ["Explain", "grouped", "register_functions", "title_case", "trimmed_mean"]
