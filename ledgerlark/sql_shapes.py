"""Relational shapes as SQL over the sources' tables: each is the Spark text and, where it differs, DuckDB's.

Results agree in type as well: counts and ranks are bigint in both, money is decimal before it is rounded.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.registering import registry
from ledgerlark.sources.catalog import SCHEMAS, load

QUERIES, ORACLES, register = registry()


def shape(name: str, text: str, duckdb: str | None = None) -> None:
    tables = [t for t in SCHEMAS if re.search(rf"\{{{t}\}}", text)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})

    query.__doc__ = text
    plain = re.sub(r"\{(\w+)\}", r"\1", duckdb or text)
    register(name, plain)(query)


# Projection, filter, predicate.
shape(
    "filter_project",
    "select l_orderkey, l_partkey, l_quantity * 2 as twice from {lineitem} where l_quantity between 10 and 20 and l_discount > 0.05",
)
shape(
    "case_coalesce_nullif",
    """select o_orderkey, case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'medium' else 'small' end
    as size, coalesce(nullif(o_orderstatus, 'F'), 'done') as status from {orders}""",
)
shape(
    "like_and_replace",
    "select p_partkey, regexp_replace(p_name, '[aeiou]', '*') as masked from {part} where p_type like '%A%' or p_name like 'p%'",
    "select p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked from part where p_type like '%A%' or p_name like 'p%'",
)
# NOT IN as what it means, a null in the list and else an anti join: as one predicate it would broadcast the list,
# whatever its size.
shape(
    "not_in_with_null",
    """select case when (select count(*) from {lineitem} where nullif(l_orderkey, 1) is null) > 0 then cast(0 as bigint)
    else (select count(*) from {orders} o where (o.o_orderkey is not null or (select count(*) from {lineitem}) = 0)
    and not exists (select 1 from {lineitem} l where nullif(l.l_orderkey, 1) = o.o_orderkey)) end as n""",
    "select count(*) as n from orders where o_orderkey not in (select nullif(l_orderkey, 1) from lineitem)",
)
shape(
    "null_safe_equality",
    """select a.o_orderkey from {orders} a where nullif(a.o_orderstatus, 'F') is not distinct from nullif(a.o_orderpriority, 'x')
    or nullif(a.o_orderstatus, 'F') is null""",
)

# Joins.
shape(
    "inner_multiway",
    """select o_orderkey, c_name, n_name, p_brand, s_name from {lineitem} join {orders} on l_orderkey = o_orderkey
    join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {part} on l_partkey = p_partkey
    join {supplier} on l_suppkey = s_suppkey where l_returnflag = 'R' and l_quantity > 45""",
)
shape(
    "left_join_counts",
    "select o_orderkey, count(l_orderkey) as n from {orders} left join {lineitem} on o_orderkey = l_orderkey group by o_orderkey",
)
shape(
    "full_join",
    """select coalesce(a.k, b.k) as k, a.n as orders, b.n as events from
    (select o_custkey as k, count(*) as n from {orders} group by 1) a full join
    (select user_id as k, count(*) as n from {events} group by 1) b on a.k = b.k""",
)
shape("semi_join", "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 150000)")
shape("anti_join", "select o_orderkey from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey)")
shape("cross_join", "select a.r_name as a, b.r_name as b from {region} a cross join {region} b")
shape(
    "theta_join",
    "select a.n_name as a, b.n_name as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
)
# Spark turns a correlated LIMIT into a row number that follows the order in which sorted rows arrive after a shuffle, which
# on a cluster is any order. So the row number has an order of its own.
shape(
    "lateral_top_one",
    """select c_custkey, o.o_orderkey from {customer} left join lateral (select o_orderkey from (select o_orderkey, row_number()
    over (order by o_totalprice desc, o_orderkey) as nth from {orders} where o_custkey = c_custkey) where nth = 1) o on true""",
    """select c_custkey, o.o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey
    order by o_totalprice desc, o_orderkey limit 1) o on true""",
)

# Aggregation.
shape(
    "pricing_summary",
    """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(38,2)) as sum_qty,
    cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(38,2)) as sum_base,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(1 - cast(l_discount as decimal(4,2)) as decimal(4,2))) as decimal(38,4)) as sum_disc,
    round(avg(l_discount), 6) as avg_disc, count(*) as n from {lineitem}
    where l_shipdate <= timestamp_ntz '2001-08-01 00:00:00' group by 1, 2""",
    """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,2)) as sum_qty,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as sum_base,
    cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2)))) as decimal(38,4)) as sum_disc,
    round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem
    where l_shipdate <= timestamp '2001-08-01 00:00:00' group by 1, 2""",
)
shape("count_distinct", "select o_orderstatus, count(distinct o_custkey) as n from {orders} group by 1")
shape(
    "filtered_aggregate",
    "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as done, count(*) as n from {orders} group by 1",
)
shape(
    "rollup",
    """select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) as bigint) as g1,
    cast(grouping(o_orderpriority) as bigint) as g2, count(*) as n from {orders} group by rollup(o_orderstatus, o_orderpriority)""",
)
shape("cube", "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by cube(l_returnflag, l_linestatus)")
shape(
    "grouping_sets",
    "select c_mktsegment, c_nationkey, count(*) as n from {customer} group by grouping sets ((c_mktsegment), (c_nationkey), ())",
)
shape("having", "select o_custkey, count(*) as n from {orders} group by 1 having count(*) >= 12")
shape(
    "statistics",
    """select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as vp,
    round(corr(value, user_id), 6) as c, max_by(event_id, struct(ts, event_id)) as latest from {events} group by 1""",
    """select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as vp,
    round(corr(value, user_id), 6) as c, arg_max(event_id, (ts, event_id)) as latest from events group by 1""",
)
shape(
    "percentiles",
    """select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as median,
    percentile_cont(0.9) within group (order by l_quantity) as p90 from {lineitem} group by 1""",
)
shape(
    "list_and_string_aggregation",
    """select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names,
    array_join(array_sort(collect_list(n_name)), '|') as listed from {nation} group by 1""",
    """select n_regionkey, string_agg(n_name, ',' order by n_name) as names,
    array_to_string(list_sort(list(n_name)), '|') as listed from nation group by 1""",
)
shape(
    "pivot",
    """select * from (select c_mktsegment, c_nationkey % 3 as k from {customer}) pivot (count(*) for k in (0 as k0, 1 as k1, 2 as k2))""",
    """select c_mktsegment, count(*) filter (where c_nationkey % 3 = 0) as k0, count(*) filter (where c_nationkey % 3 = 1) as k1,
    count(*) filter (where c_nationkey % 3 = 2) as k2 from customer group by 1""",
)
shape(
    "unpivot",
    "select p_partkey, what, v from (select p_partkey, p_brand, p_type from {part}) unpivot (v for what in (p_brand, p_type))",
    "select p_partkey, 'p_brand' as what, p_brand as v from part union all select p_partkey, 'p_type', p_type from part",
)
shape("empty_aggregate", "select sum(o_totalprice) as total, count(*) as n from {orders} where o_orderkey < 0")
shape(
    "null_groups",
    """select nullif(o_orderstatus, 'F') as s, count(distinct nullif(o_orderpriority, '5-LOW')) as d, count(*) as n,
    cast(grouping(nullif(o_orderstatus, 'F')) as bigint) as g from {orders} group by rollup(nullif(o_orderstatus, 'F'))""",
)

# Windows.
shape(
    "lag_and_lead",
    """select event_id, lag(value) over w as before, lead(value, 2) over w as later,
    lag(case when event_type = 'error' then event_id end) ignore nulls over w as last_error from {events}
    window w as (partition by user_id order by ts, event_id)""",
    """select event_id, lag(value) over w as before, lead(value, 2) over w as later,
    lag(case when event_type = 'error' then event_id end ignore nulls) over w as last_error from events
    window w as (partition by user_id order by ts, event_id)""",
)
shape(
    "rows_frame",
    """select event_id, count(*) over w as n, min(event_id) over w as low, first_value(event_id) over w as f,
    last_value(event_id) over w as l, nth_value(event_id, 2) over w as second from {events}
    window w as (partition by user_id order by ts, event_id rows between 2 preceding and 1 following)""",
)
shape(
    "range_frame",
    """select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row)
    as n from {events}""",
)
# Few event types: peers are counted before the window, so that no task holds all events of a type.
shape(
    "default_frame_with_peers",
    """with d as (select event_type, date_trunc('day', ts) as day, count(*) as n from {events} group by 1, 2),
    s as (select event_type, day, sum(n) over (partition by event_type order by day) as n from d)
    select e.event_id, s.n from {events} e join s on e.event_type <=> s.event_type and date_trunc('day', e.ts) <=> s.day""",
    "select event_id, count(*) over (partition by event_type order by date_trunc('day', ts)) as n from events",
)
shape(
    "share_of_total",
    """select c_mktsegment, count(*) / sum(count(*)) over () as share from {customer} group by 1""",
)

# Sort, limit, top-k.
shape("top_k_offset", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 10 offset 5")
shape(
    "null_placement",
    """select o_orderkey, nullif(o_orderstatus, 'F') as s from {orders} order by s asc nulls first, o_orderkey desc limit 20""",
)

# Set operations and subqueries.
shape("union_all", "select c_nationkey as k from {customer} union all select s_nationkey from {supplier}")
shape("union_distinct", "select c_nationkey as k from {customer} union select s_nationkey from {supplier}")
shape("intersect", "select o_custkey as k from {orders} intersect select user_id from {events}")
shape("except", "select o_orderkey as k from {orders} except select l_orderkey from {lineitem}")
shape("except_all", "select c_nationkey as k from {customer} except all select s_nationkey from {supplier}")
shape(
    "correlated_scalar",
    """select o_orderkey from {orders} o where o_totalprice > (select avg(o_totalprice) * 1.5 from {orders} i
    where i.o_custkey = o.o_custkey)""",
)
# Turn by turn from each conversation's first: as many rounds as the longest has turns. operators/recursive.py has no limit of rows.
shape(
    "recursive_cte",
    """with recursive t as (select conv_id, turn, role, cast(length(text) as bigint) as n from {conversations}),
    r(conv_id, turn, role, said) as (select conv_id, turn, role, n from t where turn = 0
      union all select t.conv_id, t.turn, t.role, r.said + t.n from r join t on t.conv_id = r.conv_id and t.turn = r.turn + 1)
    select conv_id, turn, role, said from r""",
)
shape(
    "pipe_syntax",
    "from {orders} |> where o_orderstatus = 'P' |> aggregate count(*) as n group by o_orderpriority",
    "select o_orderpriority, count(*) as n from orders where o_orderstatus = 'P' group by 1",
)

# Scalar functions.
shape(
    "strings",
    """select c_custkey, upper(c_mktsegment) as u, substring(c_name, 3, 4) as s, cast(length(c_name) as bigint) as n,
    concat_ws('-', c_name, c_mktsegment) as j, cast(levenshtein(c_mktsegment, 'MACHINE') as bigint) as d from {customer}""",
)
shape(
    "split_and_explode",
    "select word, count(*) as n from (select explode(split(p_name, ' ')) as word from {part}) group by 1",
    "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1",
)
shape(
    "dates",
    """select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as m, cast(year(o_orderdate) as bigint) as y,
    cast(datediff(day, timestamp_ntz '1995-01-01 00:00:00', o_orderdate) as bigint) as d, cast(dayofweek(o_orderdate) - 1 as bigint) as w
    from {orders}""",
    """select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as m, cast(year(o_orderdate) as bigint) as y,
    cast(date_diff('day', timestamp '1995-01-01 00:00:00', o_orderdate) as bigint) as d, cast(dayofweek(o_orderdate) as bigint) as w
    from orders""",
)
shape(
    "numbers",
    """select l_orderkey, l_partkey, l_linenumber, l_quantity, l_quantity / 7 as q, cast(l_quantity as bigint) % 7 as r,
    round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2)), 2) as d from {lineitem}""",
)
shape(
    "json_fields",
    "select cast(get_json_object(props, '$.k') as bigint) as k, count(*) as n from {events} group by 1",
    "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
)
shape(
    "json_map",
    "select event_id, cast(element_at(from_json(props, 'map<string,int>'), 'k') as bigint) as k, size(from_json(props, 'map<string,int>')) as n from {events}",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(len(json_keys(props)) as integer) as n from events",
)
shape(
    "variant_field",
    "select event_id, variant_get(parse_json(props), '$.k', 'bigint') as k from {events}",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
)
shape(
    "sessions_batch",
    """select user_id, session_window.start as start, count(*) as n from {events}
    group by user_id, session_window(cast(ts as timestamp), '30 minutes')""",
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute
    then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g)
    select user_id, cast(min(ts) as timestamptz) as start, count(*) as n from s group by user_id, s""",
)


@register(
    "bound_parameters",
    "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice between 1000 and 90000",
)
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a user gives are bound, never written into the text."""
    return selected_orders(spark, sf_dir, "O", 1000.0, 90000.0)


def selected_orders(spark: SparkSession, sf_dir: str, status: str, low: float, high: float) -> DataFrame:
    text = "select o_orderkey, o_totalprice from {orders} where o_orderstatus = :status and o_totalprice between :low and :high"
    return spark.sql(text, args={"status": status, "low": low, "high": high}, orders=load(spark, sf_dir, "orders"))


@register(
    "bound_identifiers",
    "select c_mktsegment as name, sum(c_acctbal) > 0 as positive, count(*) as n from customer group by 1 order by 3 desc, 1 limit 3",
)
def bound_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tables and columns that a user gives are bound as identifiers."""
    return largest_groups(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal", 3)


def largest_groups(spark: SparkSession, sf_dir: str, table: str, group: str, value: str, k: int) -> DataFrame:
    load(spark, sf_dir, table).createOrReplaceTempView(f"bound_{table}")
    text = """select identifier(:group) as name, sum(identifier(:value)) > 0 as positive, count(*) as n
    from identifier(:table) group by identifier(:group) order by n desc, name limit :k"""
    return spark.sql(text, args={"table": f"bound_{table}", "group": group, "value": value, "k": k})
