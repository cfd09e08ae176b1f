"""Answers: rows with the checks that ran on them and where they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.compile import Observed, compile_spec, observed_metric, paths
from ledgerlark.plans.spec import CATALOG, Catalog, QuerySpec
from ledgerlark.sources.catalog import SOURCES, freshness, load


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    told: str


@dataclass(frozen=True)
class Provenance:
    tables: tuple[str, ...]
    filters: tuple[str, ...]
    as_of: tuple[tuple[str, str], ...]
    plan: str


@dataclass(frozen=True)
class Answer:
    spec: QuerySpec
    rows: DataFrame
    checks: tuple[Check, ...]
    provenance: Provenance

    @property
    def verified(self) -> str:
        """Which checks ran and held; never a bare word."""
        held = [c.name for c in self.checks if c.passed]
        failed = [f"{c.name} ({c.told})" for c in self.checks if not c.passed]
        return f"held: {', '.join(held) or 'none'}" + (f"; failed: {', '.join(failed)}" if failed else "")


def tables_of(spec: QuerySpec, catalog: Catalog = CATALOG) -> tuple[str, ...]:
    found: list[str] = []
    for m in (catalog.metrics[x] for x in spec.metrics):
        found.append(m.table)
        for name in (*spec.by, *(f.dimension for f in spec.where)):
            d = catalog.dimensions[name]
            found += [j[1] for j in paths(catalog, m.table, d.table)[0]] if d.table else []
    return tuple(dict.fromkeys(found))


def parts_and_total(rows: DataFrame, total: DataFrame, metric: str) -> Check:
    """The breakdown adds up to the total, which is computed without it."""
    a = rows.agg(F.sum(metric).alias("x")).first()["x"] or 0
    b = total.first()[metric] or 0
    return Check("parts add up to the total", a == b, f"{metric}: parts {a}, total {b}")


def not_multiplied(spark: SparkSession, sf_dir: str, spec: QuerySpec, metric: str, catalog: Catalog = CATALOG) -> Check:
    """Every table joined to has one row for each key, so no row of the metric's table is counted twice."""
    m = catalog.metrics[metric]
    wrong = []
    for name in (*spec.by, *(f.dimension for f in spec.where)):
        d = catalog.dimensions[name]
        for step in paths(catalog, m.table, d.table)[0] if d.table else []:
            key = catalog.joins[step][1]
            twice = load(spark, sf_dir, step[1]).groupBy(key).count().where("count > 1").limit(1).count()
            if twice:
                wrong.append(f"{step[1]}.{key}")
    return Check("joins keep the grain", not wrong, ", ".join(wrong) or "all keys unique")


def checks_of(seen: Observed) -> list[Check]:
    """What a metric's own job saw: nothing was read again."""
    m, read, joined, kept, told = seen.metric, seen.read.get, seen.joined.get, seen.kept.get, seen.told.get
    found = [Check("joins keep the grain", read["rows"] == joined["rows"], f"{m}: {read['rows']} rows, {joined['rows']} after joins")]
    lost = {k: n for k, n in joined.items() if k != "rows" and n}
    found.append(Check("keys have partners", not lost, f"{m}: " + (", ".join(f"{n} rows: no {k}" for k, n in lost.items()) or "none without")))
    if "total" in kept:
        total, parts = kept["total"] or 0, told["parts"] or 0
        found.append(Check("parts add up to the total", parts == total, f"{m}: parts {parts}, total {total}"))
    nulls = {k: n for k, n in told.items() if k.startswith("null ") and n}
    found.append(Check("no nulls", not nulls, f"{m}: " + (", ".join(f"{n} rows: {k}" for k, n in nulls.items()) or f"{told['rows']} rows")))
    return found


def answer(spark: SparkSession, sf_dir: str, spec: QuerySpec, catalog: Catalog = CATALOG) -> Answer:
    """Runs a spec once: its rows are kept, and what its job observed on the way are the checks.

    The kept rows can be let go by answer.rows.unpersist(). Counts are of the tasks that gave the result; a stage that is
    run again after an executor was lost may count its rows twice, which shows as a failed check, never as one that holds.
    """
    seen: list[Observed] = []

    def one(*args: object) -> DataFrame:
        rows, observed = observed_metric(*args)
        seen.append(observed)
        return rows

    rows = compile_spec(spark, sf_dir, spec, catalog, one)
    plan = rows._jdf.queryExecution().optimizedPlan().toString() if hasattr(rows, "_jdf") else ""
    rows = rows.persist()
    rows.count()  # the one job
    checks = [c for observed in seen for c in checks_of(observed)]
    used = tables_of(spec, catalog)
    fresh: list[Row] = freshness(spark, sf_dir).collect()  # one row for each source
    as_of = tuple((r.source, str(r.as_of)) for r in fresh if set(SOURCES[r.source].tables) & set(used))
    filters = tuple(f"{f.dimension} {f.op} {f.value}" for f in spec.where)
    return Answer(spec, rows, tuple(checks), Provenance(used, filters, as_of, plan))
