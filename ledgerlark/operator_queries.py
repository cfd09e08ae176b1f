"""Queries by the library's own operators: long orders, inequality joins, recursion, approximate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import joins, ordered, recursive
from ledgerlark.registering import registry
from ledgerlark.sources.catalog import load

QUERIES, ORACLES, register = registry()


@register(
    "ranks",
    """select o_orderkey, cast(row_number() over w as bigint) as rn, cast(rank() over (partition by o_orderstatus order by
    date_trunc('month', o_orderdate)) as bigint) as r, cast(dense_rank() over (partition by o_orderstatus order by
    date_trunc('month', o_orderdate)) as bigint) as dr, cast(ntile(7) over w as bigint) as nt,
    percent_rank() over w as pr, cume_dist() over w as cd from orders
    window w as (partition by o_orderstatus order by o_orderdate, o_orderkey)""",
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statuses, so a window over each would hold a third of all orders in one task."""
    month = F.date_trunc("month", "o_orderdate").alias("month")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", month, "o_orderdate")
    order = ["month", "o_orderdate", "o_orderkey"]
    out = ordered.ranked(orders, ["o_orderstatus"], order, peers=1, tiles=7, shares_of_order=True)
    names = {"row_number": "rn", "rank": "r", "dense_rank": "dr", "ntile": "nt", "percent_rank": "pr", "cume_dist": "cd"}
    return out.select("o_orderkey", *(F.col(c).alias(k) for c, k in names.items()))


@register(
    "ranks_in_ranges",
    """select l_orderkey, l_linenumber, l_partkey, row_number() over w as row_number, rank() over p as rank, dense_rank() over p as dense_rank,
    percent_rank() over p as percent_rank, cume_dist() over p as cume_dist, ntile(100) over w as ntile from lineitem
    window w as (order by l_shipdate, l_orderkey, l_linenumber, l_partkey), p as (order by l_shipdate)""",
)
def ranks_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in one order: one partition value, many tasks."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return ordered.ranked(lines, [], order, peers=1, tiles=100).drop("l_shipdate")


@register(
    "inequality_join",
    """select s_suppkey, s_acctbal, count(c_custkey) as poorer, cast(coalesce(sum(cast(c_acctbal as decimal(12,2))), 0) as decimal(22,2)) as owned
    from supplier left join customer on c_acctbal < s_acctbal group by s_suppkey, s_acctbal""",
)
def inequality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the customers with a lower balance: a join by < alone."""
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    take = {"poorer": F.lit(1), "owned": F.col("c_acctbal").cast("decimal(12,2)")}
    return ordered.inequality_join(suppliers, customers, ("s_acctbal", "c_acctbal"), "<", take)


@register(
    "as_of_by_buckets",
    """with o as (select o_orderstatus as k, o_orderdate as t, max(o_orderkey) as o_key from orders group by 1, 2)
    select l_orderkey, l_linenumber, l_partkey, o_key as last_order from lineitem asof left join o
    on (case l_returnflag when 'A' then 'F' when 'N' then 'O' else 'P' end) = o.k and l_shipdate >= o.t""",
)
def as_of_by_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line the latest order of its status before it shipped: three keys, so a key's rows have to spread."""
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("t"))
    orders = orders.agg(F.max("o_orderkey").alias("o_key"))
    status = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("P")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", status.alias("status"))
    out = joins.as_of(lines, orders, ("status", "k"), ("l_shipdate", "t"), {"o_key": "last_order"}, bucket_rows=300)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "last_order")


@register(
    "reachable_suppliers_and_parts",
    """with recursive e as (
      select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem where l_returnflag = 'R' and l_quantity >= 48
      union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem where l_quantity <= 2),
    r(node, hops) as (select 's' || s_suppkey, 0 from supplier where s_suppkey < 2
      union select e.dst, r.hops + 1 from r join e on r.node = e.src where r.hops < 40)
    select node, cast(min(hops) as bigint) as hops from r group by 1""",
)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From two suppliers to the parts they had returned in bulk, to other suppliers of these in small lots, and on."""
    lines = load(spark, sf_dir, "lineitem")
    supplier, part = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    bulk = lines.where("l_returnflag = 'R' and l_quantity >= 48").select(supplier.alias("src"), part.alias("dst"))
    small = lines.where("l_quantity <= 2").select(part.alias("src"), supplier.alias("dst"))
    seeds = load(spark, sf_dir, "supplier").where("s_suppkey < 2").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return recursive.reachable(seeds, bulk.union(small).distinct())


@register("approximate_distinct")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL to compare with: sketches differ between engines. A test holds it against the exact number."""
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(
        F.approx_count_distinct("o_custkey", 0.02).alias("about"), F.count_distinct("o_custkey").alias("exact")
    )
