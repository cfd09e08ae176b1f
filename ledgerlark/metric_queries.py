"""Queries by the semantic catalog, and the operators that carry answers: collation, reconciliation, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import vectors
from ledgerlark.nl import ask
from ledgerlark.nl.ask import Conversation
from ledgerlark.nl.values import candidates, index_of
from ledgerlark.operators import joins
from ledgerlark.plans.compile import compare_sources, compile_spec, metric
from ledgerlark.plans.spec import Filter
from ledgerlark.registering import registry
from ledgerlark.sources.catalog import freshness, load

QUERIES, ORACLES, register = registry()

_ORDERS = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_LINES = "sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))))"
_MONEY = "cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,4))"


@register("revenue_by_region", f"select r_name as region, {_MONEY} as order_revenue from {_ORDERS} group by 1")
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "order_revenue", ("region",))


@register(
    "metric_filtered_by_month",
    f"""select cast(date_trunc('month', o_orderdate) as date) as month, {_MONEY} as order_revenue, count(*) as order_count
    from {_ORDERS} where r_name = 'ASIA' and c_mktsegment in ('BUILDING', 'MACHINERY') group by 1""",
)
def metric_filtered_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (Filter("region", "=", "ASIA"), Filter("segment", "in", ("BUILDING", "MACHINERY")))
    return metric(spark, sf_dir, ("order_revenue", "order_count"), ("month",), where)


@register(
    "metric_top_nations",
    f"""select n_name as nation, {_MONEY} as order_revenue from {_ORDERS} where o_orderdate >= date '1997-01-01'
    and o_orderdate < date '1998-01-01' group by 1 order by 2 desc, 1 limit 5""",
)
def metric_top_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (Filter("day", ">=", "1997-01-01"), Filter("day", "<", "1998-01-01"))
    return metric(spark, sf_dir, "order_revenue", ("nation",), where, limit=5)


@register(
    "metric_share",
    """select c_mktsegment as segment, count(*) as customer_count,
    count(*) / sum(count(*)) over () as share from customer group by 1""",
)
def metric_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, "customer_count", ("segment",), share=True)




@register(
    "metric_two_grains_region_year",
    f"""with o as (select r_name as region, cast(date_trunc('year', o_orderdate) as date) as year, {_MONEY} as order_revenue
      from {_ORDERS} group by 1, 2),
    l as (select r_name as region, cast(date_trunc('year', l_shipdate) as date) as year,
      cast({_LINES} as decimal(38,4)) as line_revenue
      from lineitem join {_ORDERS.replace('orders join', 'orders on l_orderkey = o_orderkey join', 1)} group by 1, 2)
    select coalesce(o.region, l.region) as region, coalesce(o.year, l.year) as year, order_revenue, line_revenue
    from o full join l on o.region = l.region and o.year = l.year""",
)
def metric_two_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric(spark, sf_dir, ("order_revenue", "line_revenue"), ("region", "year"))


@register(
    "ask_conversation",
    f"""select r_name as region, {_MONEY} as order_revenue from {_ORDERS} where c_mktsegment = 'BUILDING'
    and o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01' group by 1""",
)
def ask_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spec of a question and two follow-ups."""
    talk = Conversation()
    for turn in ("What is the revenue by region?", "and in 1997?", "only for building please"):
        spec = talk.hear(turn)
    return compile_spec(spark, sf_dir, spec)


@register(
    "ask_sql",
    f"""with a as (select r_name as region, {_MONEY} as order_revenue from {_ORDERS} where o_orderdate >= date '1997-01-01'
      and o_orderdate < date '1998-01-01' group by 1), b as (select r_name as region, count(*) as order_count from {_ORDERS} group by 1)
    select a.region, order_revenue, order_count from a join b on a.region = b.region where order_count > 10""",
)
def ask_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as tables of a SQL text, joined with each other."""
    text = """select a.region, a.order_revenue, b.order_count from ask('revenue by region in 1997') a
    join ask('number of orders by region') b on a.region = b.region where b.order_count > :least"""
    return ask.ask_sql(spark, sf_dir, text, least=10)


@register("ask_function", f"select r_name as region, {_MONEY} as order_revenue from {_ORDERS} where r_name like 'A%' group by 1")
def ask_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question as a table function of the session."""
    ask.define(spark, sf_dir, "revenue_by_region", "revenue by region")
    return spark.sql("select * from revenue_by_region() where region like 'A%'")


@register(
    "ask_verified",
    f"""select n_name as nation, cast({_LINES} as decimal(38,4)) as line_revenue from lineitem
    join {_ORDERS.replace('orders join', 'orders on l_orderkey = o_orderkey join', 1)} where r_name = 'ASIA' group by 1""",
)
def ask_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a whole answer; raises if one of its checks fails."""
    got = ask.ask(spark, sf_dir, "invoiced by nation in asia")
    if any(not c.passed for c in got.checks):
        raise ValueError(got.verified)
    return got.rows


@register(
    "misspelt_values",
    """with v as (select 'customer' as dimension, c_name as value from customer union select 'supplier', s_name from supplier
      union select 'nation', n_name from nation union select 'brand', p_brand from part union select 'part', p_name from part),
    w as (select distinct substr(s_name, 1, 2) || substr(s_name, 4) as word from supplier union select distinct p_name || 'x' from part)
    select word, dimension, value, cast(levenshtein(lower(word), lower(value)) as bigint) as distance from w, v
    where levenshtein(lower(word), lower(value)) <= 1""",
)
def misspelt_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values that are at most a letter away from misspelt names of suppliers and parts."""
    suppliers = load(spark, sf_dir, "supplier").select(F.concat(F.substring("s_name", 1, 2), F.expr("substring(s_name, 4)")).alias("word"))
    parts = load(spark, sf_dir, "part").select(F.concat("p_name", F.lit("x")).alias("word"))
    return candidates(index_of(spark, sf_dir), suppliers.union(parts).distinct())


@register(
    "collate_sources_by_day",
    f"""with s as (select cast(date_trunc('month', o_orderdate) as date) as month, {_MONEY} as v from orders group by 1),
    e as (select cast(date_trunc('month', l_shipdate) as date) as month, cast({_LINES} as decimal(38,4)) as v
      from lineitem group by 1)
    select coalesce(s.month, e.month) as month, s.v as sales_order_revenue, e.v as erp_line_revenue
    from s full join e on s.month = e.month""",
)
def collate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_sources(spark, sf_dir, {"sales": "order_revenue", "erp": "line_revenue"}, ("month",))


@register(
    "reconcile_order_totals",
    """with a as (select o_orderkey as k, cast(o_totalprice as decimal(18,2)) as value from orders),
    b as (select l_orderkey as k, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as value
      from lineitem group by 1)
    select coalesce(a.k, b.k) as k, a.value as a_value, b.value as b_value,
      cast(abs(a.value - b.value) as decimal(29,2)) as gap, coalesce(abs(a.value - b.value) <= 1000, false) as agrees
    from a full join b on a.k = b.k""",
)
def reconcile_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("value")
    )
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    lines = lines.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value"))
    out = joins.reconcile(orders, lines, ["k"], "value", 1000)
    return out.withColumn("gap", F.col("gap").cast("decimal(29,2)"))


@register(
    "freshness_by_source",
    """select 'erp' as source, max(l_shipdate) as as_of from lineitem union all
    select 'sales', max(o_orderdate) from orders union all select 'ops', max(ts) from events""",
)
def freshness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(spark, sf_dir)


@register(
    "as_of_order_before_event",
    """with o as (select o_custkey as k, o_orderdate + interval 9000 day as t, max(o_orderkey) as o_key from orders group by 1, 2)
    select event_id, (select o_key from o where o.k = user_id and o.t <= ts order by o.t desc limit 1) as last_order
    from events where event_type = 'purchase'""",
)
def as_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("interval 9000 day")).alias("t")
    )
    orders = orders.agg(F.max("o_orderkey").alias("o_key"))
    events = load(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = joins.as_of(events, orders, ("user_id", "k"), ("ts", "t"), {"o_key": "last_order"})
    return out.select("event_id", "last_order")


@register(
    "interval_join_errors_after_clicks",
    """select a.event_id as click, b.event_id as error from events a join events b on a.user_id = b.user_id
    where a.event_type = 'click' and b.event_type = 'error' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    errors = events.where("event_type = 'error'").select(
        F.col("event_id").alias("error"), F.col("user_id").alias("u"), F.col("ts").alias("t")
    )
    out = joins.interval(clicks, errors, ("user_id", "u"), ("ts", "t"), 0, 7200)
    return out.select(F.col("event_id").alias("click"), "error")


@register(
    "salted_join_by_segment",
    """select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1""",
)
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return joins.salted(orders, customers, "c_custkey", 4).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@register(
    "top_three_orders_by_customer",
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey
    order by o_totalprice desc, o_orderkey) as n from orders) where n <= 3""",
)
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.top_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@register(
    "embedding_similarity_to_first",
    """with q as (select embedding as e from embeddings where vec_id = 0)
    select vec_id, round(list_dot_product(cast(embedding as double[]), cast(e as double[])) /
      nullif(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) *
      sqrt(list_dot_product(cast(e as double[]), cast(e as double[]))), 0), 6) as cosine from embeddings, q""",
)
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_of = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors_of.where("vec_id = 0").select(F.col("embedding").alias("e"))
    cosine = vectors.cosine(F.col("embedding"), F.col("e"))
    return vectors_of.crossJoin(F.broadcast(query)).select("vec_id", F.round(cosine, 6).alias("cosine"))  # one row
