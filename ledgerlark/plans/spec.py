"""The typed form of one question, and the semantic catalog it refers to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Dimension:
    """A column to group or filter by. path: the tables to join, from the metric's table to this column's."""

    name: str
    table: str
    column: str
    kind: str = "value"  # or day, month, year of a time column
    synonyms: tuple[str, ...] = ()
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Metric:
    """An aggregate over one table, at that table's grain. formula is Spark SQL over its columns."""

    name: str
    source: str
    table: str
    formula: str
    kind: str  # money or count
    time: str | None = None
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter:
    dimension: str
    op: str  # =, !=, in, >=, <
    value: object


@dataclass(frozen=True)
class QuerySpec:
    """metrics by dimensions where filters, sorted by the first metric and cut to limit rows if one is given."""

    metrics: tuple[str, ...]
    by: tuple[str, ...] = ()
    where: tuple[Filter, ...] = ()
    limit: int | None = None
    ascending: bool = False
    share: bool = False

    def with_filter(self, new: Filter) -> QuerySpec:
        """The filter takes the place of one on the same dimension and operator."""
        kept = tuple(f for f in self.where if (f.dimension, f.op) != (new.dimension, new.op))
        return replace(self, where=(*kept, new))


@dataclass(frozen=True)
class Refused:
    """No query runs: the question is outside the catalog."""

    reason: str


@dataclass(frozen=True)
class ClarifyNeeded:
    """No query runs: the question has several meanings."""

    question: str
    options: tuple[str, ...]


def told_as_json(told: QuerySpec | Refused | ClarifyNeeded) -> str:
    return json.dumps({"kind": type(told).__name__} | asdict(told), sort_keys=True)


def from_json(text: str) -> QuerySpec | Refused | ClarifyNeeded:
    """What told_as_json() wrote; lists become tuples again."""
    data = json.loads(text)
    kind = data.pop("kind")
    if kind == "Refused":
        return Refused(**data)
    if kind == "ClarifyNeeded":
        return ClarifyNeeded(data["question"], tuple(data["options"]))
    where = tuple(Filter(f["dimension"], f["op"], tuple(f["value"]) if isinstance(f["value"], list) else f["value"]) for f in data["where"])
    return QuerySpec(**data | {"metrics": tuple(data["metrics"]), "by": tuple(data["by"]), "where": where})


@dataclass(frozen=True)
class Catalog:
    metrics: dict[str, Metric]
    dimensions: dict[str, Dimension]
    #: (table, table): the columns that join them; the second table is unique on its column.
    joins: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)


def _by_name(items: list) -> dict:
    return {x.name: x for x in items}


CATALOG = Catalog(
    metrics=_by_name(
        [
            Metric(
                "order_revenue",
                "sales",
                "orders",
                "sum(cast(o_totalprice as decimal(12,2)))",
                "money",
                "o_orderdate",
                ("revenue", "sales", "order value", "turnover"),
            ),
            Metric("order_count", "sales", "orders", "count(*)", "count", "o_orderdate", ("orders", "number of orders")),
            Metric(
                "line_revenue",
                "erp",
                "lineitem",
                # Short decimals: products of 18 digits are computed as longs.
                "sum(cast(l_extendedprice as decimal(12,2)) * cast(1 - cast(l_discount as decimal(4,2)) as decimal(4,2)))",
                "money",
                "l_shipdate",
                ("invoiced", "invoice value", "shipped value"),
            ),
            Metric(
                "quantity",
                "erp",
                "lineitem",
                "sum(cast(l_quantity as decimal(12,2)))",
                "money",
                "l_shipdate",
                ("units", "quantity shipped"),
            ),
            Metric("line_count", "erp", "lineitem", "count(*)", "count", "l_shipdate", ("lines", "invoice lines")),
            Metric("customer_count", "sales", "customer", "count(*)", "count", None, ("customers", "clients")),
            Metric("event_count", "ops", "events", "count(*)", "count", "ts", ("events", "activity")),
            Metric("active_users", "ops", "events", "count(distinct user_id)", "count", "ts", ("users", "active customers")),
        ]
    ),
    dimensions=_by_name(
        [
            Dimension(
                "region", "region", "r_name", synonyms=("regions",), values=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
            ),
            Dimension("nation", "nation", "n_name", synonyms=("country", "countries", "nations")),
            Dimension(
                "segment",
                "customer",
                "c_mktsegment",
                synonyms=("segments", "market segment"),
                values=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
            ),
            Dimension("customer", "customer", "c_name", synonyms=("customer name",)),
            Dimension("order_status", "orders", "o_orderstatus", synonyms=("status",), values=("F", "O", "P")),
            Dimension(
                "priority",
                "orders",
                "o_orderpriority",
                synonyms=("priorities",),
                values=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
            ),
            Dimension("brand", "part", "p_brand", synonyms=("brands",)),
            Dimension("part", "part", "p_name", synonyms=("parts", "part name", "product", "products")),
            Dimension("supplier", "supplier", "s_name", synonyms=("suppliers",)),
            Dimension("return_flag", "lineitem", "l_returnflag", synonyms=("returns", "return flag"), values=("A", "N", "R")),
            Dimension(
                "event_type",
                "events",
                "event_type",
                synonyms=("event types", "type of event"),
                values=("view", "click", "purchase", "signup", "error"),
            ),
            Dimension("year", "", "", "year", ("years", "annual", "yearly")),
            Dimension("month", "", "", "month", ("months", "monthly")),
            Dimension("day", "", "", "day", ("days", "daily")),
        ]
    ),
    joins={
        ("orders", "customer"): ("o_custkey", "c_custkey"),
        ("customer", "nation"): ("c_nationkey", "n_nationkey"),
        ("nation", "region"): ("n_regionkey", "r_regionkey"),
        ("lineitem", "orders"): ("l_orderkey", "o_orderkey"),
        ("lineitem", "part"): ("l_partkey", "p_partkey"),
        ("lineitem", "supplier"): ("l_suppkey", "s_suppkey"),
        ("events", "customer"): ("user_id", "c_custkey"),
    },
)
