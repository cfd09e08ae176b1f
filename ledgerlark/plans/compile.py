"""Checks a QuerySpec against the catalog and turns it into a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.joins import collate
from ledgerlark.plans.spec import CATALOG, Catalog, ClarifyNeeded, Filter, Metric, QuerySpec, Refused
from ledgerlark.sources.catalog import load

OPERATORS = ("=", "!=", "in", ">=", "<")


def paths(catalog: Catalog, start: str, end: str) -> list[list[tuple[str, str]]]:
    """All shortest ways from one table to another over joins that keep start's grain."""
    level, seen = [([], start)], {start}
    while level:
        found = [p for p, at in level if at == end]
        if found:
            return found
        level = [(p + [j], j[1]) for p, at in level for j in catalog.joins if j[0] == at and j[1] not in seen]
        seen |= {at for _, at in level}
    return []


def check(spec: QuerySpec, catalog: Catalog = CATALOG) -> Refused | ClarifyNeeded | None:
    """What stands against running the spec: unknown names or values, columns that can't be reached, fan-out."""
    if not spec.metrics:
        return Refused("no metric was named")
    for name in spec.metrics:
        if name not in catalog.metrics:
            return Refused(f"unknown metric {name}")
    for name in (*spec.by, *(f.dimension for f in spec.where)):
        if name not in catalog.dimensions:
            return Refused(f"unknown dimension {name}")
    for f in spec.where:
        known = catalog.dimensions[f.dimension].values
        wanted = f.value if f.op == "in" else [f.value]
        if f.op not in OPERATORS:
            return Refused(f"unknown operator {f.op}")
        if known and f.op in ("=", "!=", "in") and not set(wanted) <= set(known):
            return Refused(f"unknown value of {f.dimension}: {sorted(set(wanted) - set(known))}")
    for m in (catalog.metrics[x] for x in spec.metrics):
        for name in (*spec.by, *(f.dimension for f in spec.where)):
            d = catalog.dimensions[name]
            if not d.table:
                if m.time is None:
                    return Refused(f"{m.name} has no date")
                continue
            ways = paths(catalog, m.table, d.table)
            if not ways:
                return Refused(f"{m.name} can't be told by {name}: no join keeps one row for each {m.table} row")
            if len(ways) > 1:
                told = tuple(" - ".join([m.table, *(j[1] for j in w)]) for w in ways)
                return ClarifyNeeded(f"{name} of {m.name} by which way?", told)
    return None


def _column(catalog: Catalog, metric: str, dimension: str) -> Column:
    d, m = catalog.dimensions[dimension], catalog.metrics[metric]
    if d.kind == "value":
        return F.col(d.column)
    return F.date_trunc(d.kind, F.col(m.time)).cast("date")


def _condition(column: Column, f: Filter, kind: str) -> Column:
    value = F.lit(f.value).cast("date") if kind != "value" and f.op != "in" else f.value
    return {
        "=": lambda: column == value,
        "!=": lambda: column != value,
        "in": lambda: column.isin(list(f.value)),
        ">=": lambda: column >= value,
        "<": lambda: column < value,
    }[f.op]()


def steps_of(catalog: Catalog, spec: QuerySpec, metric: str) -> list[tuple[str, str]]:
    """The joins that a metric's dimensions and filters need, each once, in order."""
    steps: list[tuple[str, str]] = []
    for name in (*spec.by, *(f.dimension for f in spec.where)):
        d = catalog.dimensions[name]
        for step in paths(catalog, catalog.metrics[metric].table, d.table)[0] if d.table else []:
            if step not in steps:
                steps.append(step)
    return steps


def one_metric(spark: SparkSession, sf_dir: str, spec: QuerySpec, metric: str, catalog: Catalog = CATALOG) -> DataFrame:
    """The metric by the spec's dimensions; only tables on the way are read, and rows are filtered before they join."""
    out = load(spark, sf_dir, catalog.metrics[metric].table)
    for step in steps_of(catalog, spec, metric):
        a, b = catalog.joins[step]
        out = out.join(load(spark, sf_dir, step[1]), F.col(a) == F.col(b), "left")
    for f in spec.where:
        out = out.where(_condition(_column(catalog, metric, f.dimension), f, catalog.dimensions[f.dimension].kind))
    return _grouped(out, spec, metric, catalog)


def _value(m: Metric) -> Column:
    return F.expr(m.formula).cast("decimal(38,4)" if m.kind == "money" else "bigint")


def _grouped(out: DataFrame, spec: QuerySpec, metric: str, catalog: Catalog) -> DataFrame:
    value = _value(catalog.metrics[metric]).alias(metric)
    if not spec.by:
        return out.agg(value)
    return out.groupBy(*(_column(catalog, metric, x).alias(x) for x in spec.by)).agg(value)


@dataclass
class Observed:
    """What a metric's own job counted on its way: rows of its table, after joins, after filters, and of the result."""

    metric: str
    read: Observation
    joined: Observation
    kept: Observation
    told: Observation


def observed_metric(
    spark: SparkSession, sf_dir: str, spec: QuerySpec, metric: str, catalog: Catalog = CATALOG
) -> tuple[DataFrame, Observed]:
    """one_metric() with observations on the way, for an answer that is verified by the job that makes it.

    Filters on the metric's own table come before the joins; others are checked after the joins were counted, so that a
    join that multiplies rows shows however few of them are asked for.
    """
    m = catalog.metrics[metric]
    seen = Observed(metric, *(Observation(f"{metric}_{x}_{uuid.uuid4().hex}") for x in ("read", "joined", "kept", "told")))
    is_own = lambda f: catalog.dimensions[f.dimension].table in ("", m.table)
    condition = lambda f: _condition(_column(catalog, metric, f.dimension), f, catalog.dimensions[f.dimension].kind)
    out = load(spark, sf_dir, m.table)
    for f in filter(is_own, spec.where):
        out = out.where(condition(f))
    out = out.observe(seen.read, F.count("*").alias("rows"))
    missing = []
    for step in steps_of(catalog, spec, metric):
        a, b = catalog.joins[step]
        out = out.join(load(spark, sf_dir, step[1]), F.col(a) == F.col(b), "left")
        missing.append(F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias(f"{a} in {step[1]}"))
    out = out.observe(seen.joined, F.count("*").alias("rows"), *missing)
    for f in spec.where:
        if not is_own(f):
            out = out.where(condition(f))
    value = _value(m)
    totals = [] if "distinct" in m.formula else [value.alias("total")]  # distinct counts do not add up
    out = out.observe(seen.kept, F.count("*").alias("rows"), *totals)
    rows = _grouped(out, spec, metric, catalog)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in rows.columns]
    return rows.observe(seen.told, F.count("*").alias("rows"), F.sum(metric).alias("parts"), *nulls), seen


def compile_spec(
    spark: SparkSession, sf_dir: str, spec: QuerySpec, catalog: Catalog = CATALOG, one: Callable[..., DataFrame] = one_metric
) -> DataFrame:
    """The spec's DataFrame. Metrics are aggregated by themselves first, by one(), so no join can count a row twice."""
    problem = check(spec, catalog)
    if problem:
        raise ValueError(problem)
    parts = [one(spark, sf_dir, spec, m, catalog) for m in spec.metrics]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(spec.by), "full") if spec.by else out.crossJoin(p)  # one row each
    first = spec.metrics[0]
    if spec.share:
        total = F.sum(first).over(_everything())
        out = out.withColumn("share", F.try_divide(F.col(first).cast("double"), total.cast("double")))
    if spec.limit is not None:
        value = F.col(first).asc_nulls_last() if spec.ascending else F.col(first).desc_nulls_last()
        out = out.orderBy(value, *(F.col(x).asc_nulls_first() for x in spec.by)).limit(spec.limit)
    return out


def _everything():
    from pyspark.sql import Window

    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def metric(
    spark: SparkSession,
    sf_dir: str,
    name: str | tuple[str, ...],
    by: tuple[str, ...] = (),
    where: tuple[Filter, ...] = (),
    **options: object,
) -> DataFrame:
    """metric("order_revenue", by=("region",)): the spec's short form."""
    names = (name,) if isinstance(name, str) else tuple(name)
    return compile_spec(spark, sf_dir, QuerySpec(names, tuple(by), tuple(where), **options))


def compare_sources(spark: SparkSession, sf_dir: str, metrics: dict[str, str], by: tuple[str, ...], where: tuple[Filter, ...] = ()) -> DataFrame:
    """Metrics of several sources side by side, named source_metric."""
    parts = {s: one_metric(spark, sf_dir, QuerySpec((m,), by, where), m) for s, m in metrics.items()}
    return collate(parts, list(by))
