"""Random valid specs against SQL that is written from the spec alone."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlark.plans.compile import check, compile_spec
from ledgerlark.plans.spec import CATALOG, Filter, QuerySpec
from tests.oracle import compare

SF = "/root/testdata/sf0.001"

#: Everything a metric's table can reach, joined in full.
WIDE = {
    "orders": "orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey "
    "left join region on n_regionkey = r_regionkey",
    "customer": "customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "lineitem": "lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey "
    "left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey "
    "left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey",
    "events": "events left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey "
    "left join region on n_regionkey = r_regionkey",
}


def sql_of(spec):
    m = CATALOG.metrics[spec.metrics[0]]

    def column(name):
        d = CATALOG.dimensions[name]
        return d.column if d.kind == "value" else f"cast(date_trunc('{d.kind}', {m.time}) as date)"

    conditions = []
    for f in spec.where:
        if f.op == "in":
            conditions.append(f"{column(f.dimension)} in ({', '.join(repr(v) for v in f.value)})")
        else:
            value = repr(f.value) if CATALOG.dimensions[f.dimension].kind == "value" else f"date '{f.value}'"
            conditions.append(f"{column(f.dimension)} {f.op} {value}")
    kind = "decimal(38,4)" if m.kind == "money" else "bigint"
    chosen = [f"{column(b)} as {b}" for b in spec.by] + [f"cast({m.formula} as {kind}) as {m.name}"]
    where = f" where {' and '.join(conditions)}" if conditions else ""
    group = f" group by {', '.join(column(b) for b in spec.by)}" if spec.by else ""
    return f"select {', '.join(chosen)} from {WIDE[m.table]}{where}{group}"


dimensions = st.sampled_from(sorted(CATALOG.dimensions))
with_values = sorted(d.name for d in CATALOG.dimensions.values() if d.values)


@st.composite
def filters(draw):
    if draw(st.booleans()):
        d = CATALOG.dimensions[draw(st.sampled_from(with_values))]
        op = draw(st.sampled_from(["=", "!=", "in"]))
        if op == "in":
            return Filter(d.name, op, tuple(draw(st.lists(st.sampled_from(d.values), min_size=1, unique=True))))
        return Filter(d.name, op, draw(st.sampled_from(d.values)))
    year = draw(st.integers(1995, 2002))
    return Filter("day", draw(st.sampled_from([">=", "<"])), f"{year}-06-15")


specs = st.builds(
    QuerySpec,
    st.tuples(st.sampled_from(sorted(CATALOG.metrics))),
    st.lists(dimensions, max_size=2, unique=True).map(tuple),
    st.lists(filters(), max_size=2).map(tuple),
)


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(specs.filter(lambda s: check(s) is None))
def test_spec_equals_its_sql(spark, spec):
    assert compare(compile_spec(spark, SF, spec), sql_of(spec), SF) in (None, "the SQL gives no rows")
