"""Registered queries: probability functions (J) and extension points (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.functions import registry
from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.sources.tables import Tables
from quadtide.vocab import UNC

# One literal per part: a normal, a uniform, or text that is no distribution.
_TEXT_SQL = """CASE p_partkey % 6 WHEN 0 THEN 'N(' || p_size || ',' || (p_size + 1) || '.5)' WHEN 1 THEN 'U(' || p_size || ', ' || (p_size + 10) || ')'
 WHEN 2 THEN 'X(1,2)' WHEN 3 THEN 'N(' || p_size || ',0)' WHEN 4 THEN 'U(3,1)' ELSE 'N(-' || p_size || ',2e1)' END"""
_PARSED = f"(SELECT p_partkey, p_size, {s.parsed('text')} FROM (SELECT *, {_TEXT_SQL} AS text FROM part))"


def _parts(t: Tables):
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("N("), size, F.lit(","), (F.col("p_size") + 1).cast("string"), F.lit(".5)")))
        .when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("U("), size, F.lit(", "), (F.col("p_size") + 10).cast("string"), F.lit(")")))
        .when(F.col("p_partkey") % 6 == 2, "X(1,2)").when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("N("), size, F.lit(",0)")))
        .when(F.col("p_partkey") % 6 == 4, "U(3,1)").otherwise(F.concat(F.lit("N(-"), size, F.lit(",2e1)")))
    )
    return let(t.part.select("p_partkey", "p_size", "p_retailprice"), d=u.parse(text))




@query("J1_parse", f"SELECT p_partkey, kind, a, b FROM {_PARSED}")
def _j1(t: Tables):
    return _parts(t).select("p_partkey", "d.kind", "d.a", "d.b")


def _against(name: str, k_sql: str, expr, k):
    sql = f"SELECT p_partkey, abs(round({expr(s.cdf('kind', 'a', 'b', k_sql))}, 6)) AS p FROM {_PARSED}"

    def build(t: Tables, fn):
        return _parts(t).select("p_partkey", F.round(fn(u.from_struct(F.col("d")), k), 6).alias("p"))

    return sql, build


for _id, _fn, _k_sql, _expr in (
    ("J2_less_than_number", u.less_than, "12.5 - 1e-7", lambda c: c),
    ("J3_less_or_equal_number", u.less_or_equal, "12.5", lambda c: c),
    ("J4_greater_than_number", u.greater_than, "12.5 + 1e-7", lambda c: f"(1 - {c})"),
    ("J5_greater_or_equal_number", u.greater_or_equal, "12.5", lambda c: f"(1 - {c})"),
):
    _sql, _build = _against(_id, _k_sql, _expr, 12.5)
    query(_id, _sql)(lambda t, _build=_build, _fn=_fn: _build(t, _fn))


# Pairs of readings: each order line against its part, in all four combinations of families.
_PAIR_SQL = f"""(SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, CAST(p_size AS DOUBLE) AS z FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_LESS = f"""CASE n % 4 WHEN 0 THEN {s.less_nn('q', '(q+1)', 'z', '4.0')}
 WHEN 1 THEN {s.less_uu('q', '(q+10)', 'z', '(z+5)')}
 WHEN 2 THEN {s.less_nu('q', '(q+1)', 'z', '(z+5)')}
 ELSE 1 - {s.less_nu('z', '4.0', 'q', '(q+10)')} END"""


def _pairs(t: Tables):
    line = t.lineitem.select("l_partkey", F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("z"))
    rows = line.join(part, "l_partkey")
    # Left is normal for n % 4 in (0, 2), right is normal for n % 4 in (0, 3).
    m = F.col("n") % 4
    x = u.Uncertain(F.when(m.isin(0, 2), "N").otherwise("U"), {"N": (F.col("q"), F.col("q") + 1), "U": (F.col("q"), F.col("q") + 10)})
    y = u.Uncertain(F.when(m.isin(0, 3), "N").otherwise("U"), {"N": (F.col("z"), F.lit(4.0)), "U": (F.col("z"), F.col("z") + 5)})
    return rows, x, y


@query("J6_less_than_distribution", f"SELECT o, n, q, abs(round({_LESS}, 6)) AS p FROM {_PAIR_SQL}")
def _j6(t: Tables):
    rows, x, y = _pairs(t)
    return rows.select("o", "n", "q", F.round(u.less_than(x, y), 6).alias("p"))


@query("J7_greater_than_distribution", f"SELECT o, n, q, abs(round(1 - ({_LESS}), 6)) AS p FROM {_PAIR_SQL}")
def _j7(t: Tables):
    rows, x, y = _pairs(t)
    return rows.select("o", "n", "q", F.round(u.greater_than(x, y), 6).alias("p"))


@query(
    "J8_between",
    f"""SELECT p_partkey, round({s.cdf('kind', 'a', 'b', '20')} - {s.cdf('kind', 'a', 'b', '5')}, 6) AS p,
 CASE WHEN p_size > 5 AND p_size <= 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS point, NULL::DOUBLE AS wrong FROM {_PARSED}""",
)
def _j8(t: Tables):
    d = u.from_struct(F.col("d"))
    return _parts(t).select(
        "p_partkey", F.round(u.between(d, 5, 20), 6).alias("p"), u.between(F.col("p_size"), 5, 20).alias("point"),
        u.between(d, 20, 5).alias("wrong"),
    )


@query(
    "J9_add_subtract_number",
    f"""SELECT p_partkey, kind, a + 2.5 AS add_a, CASE kind WHEN 'N' THEN b ELSE b + 2.5 END AS add_b,
 a - p_size AS sub_a, CASE kind WHEN 'N' THEN b ELSE b - p_size END AS sub_b FROM {_PARSED}""",
)
def _j9(t: Tables):
    d = u.from_struct(F.col("d"))
    up, down = u.add(d, 2.5), u.subtract(d, F.col("p_size"))
    return _parts(t).select(
        "p_partkey", F.col("d.kind").alias("kind"), up.a.alias("add_a"), up.b.alias("add_b"), down.a.alias("sub_a"), down.b.alias("sub_b")
    )


@query(
    "J10_add_subtract_distributions",
    f"""SELECT p_partkey, CASE kind WHEN 'N' THEN a + p_size END AS add_a, CASE kind WHEN 'N' THEN b + 2.25 END AS add_b,
 CASE kind WHEN 'N' THEN a - p_size END AS sub_a, CASE kind WHEN 'N' THEN b + 2.25 END AS sub_b, true AS uniforms_fail FROM {_PARSED}""",
)
def _j10(t: Tables):
    d, other = u.from_struct(F.col("d")), u.normal(F.col("p_size"), F.lit(2.25))
    up, down = u.add(d, other), u.subtract(d, other)
    fail = u.add(u.uniform(0.0, 1.0), u.uniform(0.0, 1.0)).struct().isNull() & u.add(5.0, d).struct().isNull()
    return _parts(t).select(
        "p_partkey", up.a.alias("add_a"), up.b.alias("add_b"), down.a.alias("sub_a"), down.b.alias("sub_b"), fail.alias("uniforms_fail")
    )


@query("J11_add_subtract_numbers", "SELECT p_partkey, p_size + p_retailprice AS plus, p_size - p_retailprice AS less FROM part")
def _j11(t: Tables):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", u.add(size, price).a.alias("plus"), u.subtract(size, price).a.alias("less"))


@query(
    "J12_probability_in_expressions",
    f"""SELECT p_partkey, {s.cdf('kind', 'a', 'b', '10 - 1e-7')} >= 0.3 OR 1 - ({s.cdf('kind', 'a', 'b', '30 + 1e-7')}) >= 0.3 AS extreme,
 {s.cdf('kind', 'a', 'b', '10 - 1e-7')} + 1 > 1.2 AS shifted FROM {_PARSED}""",
)
def _j12(t: Tables):
    low, high = u.less_than(u.from_struct(F.col("d")), 10), u.greater_than(u.from_struct(F.col("d")), 30)
    return _parts(t).select("p_partkey", ((low >= 0.3) | (high >= 0.3)).alias("extreme"), (low + 1 > 1.2).alias("shifted"))


@query(
    "J13_sampled_comparison",
    "SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(count(*) AS BIGINT) AS lines, true AS close FROM lineitem GROUP BY l_quantity",
)
def _j13(t: Tables):
    # Sampling runs once per distinct pair of arguments; the lines only share its result.
    rows = t.lineitem.select(F.col("l_quantity").alias("q"))
    x = F.struct(F.lit("N").alias("kind"), F.col("q").alias("a"), (F.col("q") + 1).alias("b"))
    y = F.struct(F.lit("U").alias("kind"), F.lit(20.0).alias("a"), F.lit(30.0).alias("b"))
    sampled = u.memoised(rows, ["q"], "p", u.sampled_less_than()(x, y))
    exact = u.less_than(u.normal(F.col("q"), F.col("q") + 1), u.uniform(20.0, 30.0))
    out = sampled.groupBy("q").agg(F.count(F.lit(1)).alias("lines"), F.max("p").alias("p"))
    # Three standard errors of 10,000 draws are at most 0.015.
    return out.select("q", "lines", (F.abs(F.col("p") - exact) < 0.02).alias("close"))


@query(
    "J13_sampled_new_family",
    """SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(count(*) AS BIGINT) AS lines,
 1 - (exp(-20.0 / CAST(l_quantity AS DOUBLE)) - exp(-30.0 / CAST(l_quantity AS DOUBLE))) * CAST(l_quantity AS DOUBLE) / 10.0 > 0.5 AS likely,
 true AS close FROM lineitem GROUP BY l_quantity""",
)
def _j13_new(t: Tables):
    # P(X < Y) of X ~ E(1/q), a registered family without a closed form here, and Y ~ U(20, 30).
    q = F.col("q")
    rows = t.lineitem.select(F.col("l_quantity").cast("double").alias("q"))
    x = F.struct(F.lit("E").alias("kind"), (1 / q).alias("a"), F.lit(None).cast("double").alias("b"))
    y = F.struct(F.lit("U").alias("kind"), F.lit(20.0).alias("a"), F.lit(30.0).alias("b"))
    _register_exponential()
    try:
        estimate = u.sampled_less_than()(x, y)
    finally:
        u.KINDS.pop("E")
    sampled = u.memoised(rows, ["q"], "p", estimate)
    exact = 1 - (F.exp(-20.0 / q) - F.exp(-30.0 / q)) * q / 10.0
    out = sampled.groupBy("q").agg(F.count(F.lit(1)).alias("lines"), F.max("p").alias("p"))
    return out.select("q", "lines", (exact > 0.5).alias("likely"), (F.abs(F.col("p") - exact) < 0.02).alias("close"))


@query("J14_memoised_evaluation", f"SELECT l_orderkey AS o, l_linenumber AS n, round({s.phi('((l_quantity - 25) / 7.0)')}, 6) AS p FROM lineitem")
def _j14(t: Tables):
    p = F.round(u.less_or_equal(u.normal(25.0, 49.0), F.col("q")), 6)
    rows = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return u.memoised(rows, ["q"], "p", p).drop("q")


@query(
    "J15_fuzzy_logic",
    """SELECT l_orderkey AS o, l_linenumber AS n, least(l_discount * 10, l_tax * 10) AS conj, greatest(l_discount * 10, l_tax * 10) AS disj,
 greatest(1 - l_discount * 10, l_tax * 10) AS impl, 1 - l_discount * 10 AS neg FROM lineitem""",
)
def _j15(t: Tables):
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    return t.lineitem.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), u.fuzzy_and(a, b).alias("conj"),
        u.fuzzy_or(a, b).alias("disj"), u.fuzzy_implies(a, b).alias("impl"), u.fuzzy_not(a).alias("neg"),
    )


@query(
    "L1_functions_by_iri",
    f"""SELECT p_partkey, round({s.cdf('kind', 'a + 1', "(CASE kind WHEN 'N' THEN b ELSE b + 1 END)", '12.5 - 1e-7')}, 6) AS p,
 round({s.cdf('kind', 'a', 'b', '20')} - {s.cdf('kind', 'a', 'b', '5')}, 6) AS mid, p_size * 2.0::DOUBLE AS twice FROM {_PARSED}""",
)
def _l1(t: Tables):
    registry.register("http://example.org/fn/twice", lambda x: x.cast("double") * 2.0)
    d = u.from_struct(F.col("d"))
    return _parts(t).select(
        "p_partkey", F.round(registry.call(UNC + "lessThan", registry.call(UNC + "add", d, 1), 12.5), 6).alias("p"),
        F.round(registry.call(UNC + "between", d, 5, 20), 6).alias("mid"),
        registry.call("http://example.org/fn/twice", F.col("p_size")).alias("twice"),
    )


@query(
    "L2_aggregate_by_iri",
    "SELECT l_returnflag AS flag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS weighted FROM lineitem GROUP BY l_returnflag",
)
def _l2(t: Tables):
    registry.register_aggregate("http://example.org/agg/weightedMean", lambda x, w: F.sum(x * w) / F.sum(w))
    mean = registry.aggregate("http://example.org/agg/weightedMean", F.col("l_extendedprice"), F.col("l_quantity"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(mean, 2).alias("weighted"))


@query("L3_custom_datatype", f"SELECT p_partkey, kind, a, b, true AS same FROM {_PARSED} WHERE kind IS NOT NULL")
def _l3(t: Tables):
    rows = _parts(t).where(F.col("d").isNotNull())
    back = let(rows, again=u.parse(u.from_struct(F.col("d")).text()))
    return back.select("p_partkey", "d.kind", "d.a", "d.b", (F.col("d") == F.col("again")).alias("same"))


def _register_exponential() -> None:
    """A family with one parameter, E(rate)."""
    u.register_kind("E", u.Kind(
        valid=lambda a, b: a > 0,
        cdf=lambda a, b, k: F.when(k <= 0, 0.0).otherwise(1.0 - F.exp(-a * k)),
        shift=lambda a, b, k: (F.lit(None).cast("double"), F.lit(None).cast("double")),
        args=1,
        draw=lambda rng, a, b, n: rng.exponential(1.0 / a, n),
    ))


@query(
    "L4_new_distribution_kind",
    """SELECT p_partkey, CASE WHEN p_size > 0 THEN round(1 - exp(-(p_size / 10.0) * (0.4 - 1e-7)), 6) END AS p FROM part""",
)
def _l4(t: Tables):
    _register_exponential()
    try:
        text = F.concat(F.lit("E("), (F.col("p_size") / 10.0).cast("string"), F.lit(")"))
        rows = let(t.part, d=u.parse(text))
        return rows.select("p_partkey", F.round(u.less_than(u.from_struct(F.col("d")), 0.4), 6).alias("p"))
    finally:
        # The registry is global; the other queries know the two given families only.
        u.KINDS.pop("E")
