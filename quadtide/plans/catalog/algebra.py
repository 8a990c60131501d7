"""Registered queries: filters, BIND, projection (D), joins and set operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.functions import uncertainty as u
from quadtide.operators import algebra as a
from quadtide.operators import grouping as g
from quadtide.operators import patterns as p
from quadtide.operators import skew
from quadtide.operators import windows as w
from quadtide.operators.patterns import Pattern, Quoted
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.plans.catalog.views import (
    CUSTOMER_SQL, PLACE_SQL, customer_quads, event_quads, event_ticks, hours, node, ont, place_quads,
)
from quadtide.sources.tables import Tables
from quadtide import vocab


@query("D1_filter", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice / nullif(o_custkey % 7, 0) > 50000")
def _d1(t: Tables):
    divisor = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 7)
    rows = t.orders.where(F.try_divide(F.col("o_totalprice"), divisor) > 50000)
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query(
    "D2_bind_expression",
    """SELECT o_orderkey AS id, round(o_totalprice / nullif(o_custkey % 5, 0), 4) AS share FROM orders""",
)
def _d2(t: Tables):
    share = F.round(F.try_divide(F.col("o_totalprice"), (F.col("o_custkey") % 5).cast("double")), 4)
    return a.bind(t.orders, "share", share).select(F.col("o_orderkey").alias("id"), "share")


@query("D3_bind_constant", "SELECT s_suppkey AS id, 'checked' AS state FROM supplier")
def _d3(t: Tables):
    return a.bind(t.supplier.select(F.col("s_suppkey").alias("id")), "state", F.lit("checked"))


@query("D4_bind_variable", "SELECT s_suppkey AS id, s_name AS name, s_name AS label FROM supplier")
def _d4(t: Tables):
    return a.bind(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "label", F.col("name"))


@query(
    "D5_let",
    "SELECT l_orderkey AS id, l_quantity * 2 AS twice FROM lineitem WHERE l_linenumber = l_quantity",
)
def _d5(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    rows = a.let_(a.let_(rows, "twice", F.col("l_quantity") * 2), "l_linenumber", F.col("l_quantity"))
    return rows.select("id", "twice")


@query("D6_projection", f"SELECT o AS name FROM {CUSTOMER_SQL} WHERE p = '{ont('name')}'")
def _d6(t: Tables):
    return a.project(p.match(customer_quads(t), Pattern("?c", ont("name"), "?name")), "name")


@query(
    "D7_select_expressions",
    "SELECT p_partkey, upper(p_type) || '/' || p_brand AS label, p_retailprice * 1.25 AS _c2 FROM part",
)
def _d7(t: Tables):
    label = F.concat(F.upper("p_type"), F.lit("/"), F.col("p_brand"))
    return a.project(t.part, "p_partkey", ("label", label), F.col("p_retailprice") * 1.25)


@query(
    "D8_select_all",
    f"""SELECT tick, {node('observation', 'event_id')} AS obs, '"N(0,' || json_extract_string(props, '$.k') || '.5)"^^<{vocab.DISTRIBUTION}>' AS unc
 FROM (SELECT tick, {s.upper(6)} AS up FROM {s.ticks(24, 24)}) JOIN events ON ts >= up - INTERVAL 24 HOUR AND ts < up WHERE event_type = 'error'""",
)
def _d8(t: Tables):
    ticks = event_ticks(t, 24, 24)
    stream = w.spans(event_quads(t, where=F.col("event_type") == "error"), "ts", hours(24, 6, ticks), ticks)
    hidden = p.blank()
    found = p.match(stream, Pattern(Quoted("?obs", None, hidden), vocab.UNCERTAINTY, "?unc"), keep=[w.LO, w.HI])
    return a.visible(w.unfold(found, ticks))


@query(
    "D9_groups",
    f"""SELECT c.s AS c, c.o AS n FROM {CUSTOMER_SQL} c JOIN {CUSTOMER_SQL} b ON b.s = c.s AND b.p = '{ont('balance')}'
 WHERE c.p = '{ont('nation')}' AND b.o_num > 5000""",
)
def _d9(t: Tables):
    quads = customer_quads(t)
    inner = a.group(
        t.spark, p.match(quads, Pattern("?c", ont("balance"), None, carry={"balance": "o_num"})),
        filters=[F.col("balance") > 5000],
    )
    return a.group(t.spark, p.match(quads, Pattern("?c", ont("nation"), "?n")), inner).select("c", "n")


@query(
    "D11_inline_values",
    f"""SELECT c.s AS c, v.label AS label FROM {CUSTOMER_SQL} c JOIN (VALUES ('"BUILDING"', 'b'), ('"MACHINERY"', 'm')) v(segment, label) ON c.o = v.segment WHERE c.p = '{ont('segment')}'""",
)
def _d11(t: Tables):
    rows = [('"BUILDING"', "b"), ('"MACHINERY"', "m")]
    inline = a.values(t.spark, {"segment": "string", "label": "string"}, rows)
    return a.join_values(p.match(customer_quads(t), Pattern("?c", ont("segment"), "?segment")), inline, rows).select("c", "label")


@query(
    "D11_inline_values_undef",
    """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, v.label AS label FROM orders
 JOIN (VALUES ('F', NULL, 'any F'), (NULL, '1-URGENT', 'urgent'), ('O', '5-LOW', 'open low')) v(st, pr, label)
 ON (v.st IS NULL OR v.st = o_orderstatus) AND (v.pr IS NULL OR v.pr = o_orderpriority)""",
)
def _d11_undef(t: Tables):
    rows = [("F", None, "any F"), (None, "1-URGENT", "urgent"), ("O", "5-LOW", "open low")]
    inline = a.values(t.spark, {"status": "string", "priority": "string", "label": "string"}, rows)
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return a.join_values(orders, inline, rows)


@query(
    "D12_parameter_sweep",
    f"""SELECT threshold, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS threshold)
 WHERE {s.cdf("'U'", 'value - 25', 'value + 25', '50 - 1e-7')} >= threshold GROUP BY threshold""",
)
def _d12(t: Tables):
    chance = u.less_than(u.uniform(F.col("value") - 25, F.col("value") + 25), 50.0)
    swept = a.for_each(t.events.select(chance.alias("p")), "threshold", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    return swept.where(F.col("p") >= F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


# Joins and set operators ------------------------------------------------------------------------


@query(
    "E1_inner_join",
    "SELECT l_orderkey AS id, l_linenumber AS line, o_custkey AS customer FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
)
def _e1(t: Tables):
    orders = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return a.join(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")), orders)


@query(
    "E1_inner_join_hot_key",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS pairs, round(sum(value * weight), 2) AS total FROM events
 JOIN (SELECT DISTINCT event_type, CAST(length(event_type) AS DOUBLE) AS weight FROM events) USING (event_type) GROUP BY event_type""",
)
def _e1_hot(t: Tables):
    weights = t.events.select("event_type").distinct().withColumn("weight", F.length("event_type").cast("double"))
    joined = skew.skew_join(t.events.select("event_type", "value"), weights, ["event_type"], salts=8)
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.col("value") * F.col("weight")), 2).alias("total"))


@query(
    "E2_sequence",
    """SELECT c_name AS customer, n_name AS nation, r_name AS region, CAST(count(*) AS BIGINT) AS orders FROM orders
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
)
def _e2(t: Tables):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("orders"))
    customer = t.customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("customer"))
    nation = t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("nation"))
    region = t.region.select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region"))
    return a.group(t.spark, orders, customer, nation, region).select("customer", "nation", "region", "orders")


@query("E3_no_shared_variable", "SELECT c_custkey AS c, r_name AS region FROM customer, region")
def _e3(t: Tables):
    return a.join(t.customer.select(F.col("c_custkey").alias("c")), t.region.select(F.col("r_name").alias("region")))


_OPTIONAL_SQL = """SELECT c_custkey AS c, o_orderkey AS id FROM customer
 LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey"""


def _customer_orders(t: Tables):
    customer = t.customer.select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("balance"))
    orders = t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return customer, orders


@query("E4_optional", _OPTIONAL_SQL)
def _e4(t: Tables):
    customer, orders = _customer_orders(t)
    return a.optional(customer, orders.where(F.col("o_orderstatus") == "P")).select("c", "id")


@query(
    "E4_optional_with_filter",
    "SELECT c_custkey AS c, o_orderkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40",
)
def _e4_filter(t: Tables):
    customer, orders = _customer_orders(t)
    return a.optional(customer, orders, F.col("o_totalprice") > F.col("balance") * 40).select("c", "id")


@query(
    "E4_optional_after_optional",
    """WITH l AS (SELECT c_custkey AS c, o_orderkey AS id FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) ON o_custkey = c_custkey),
 r AS (SELECT o_custkey AS c, o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT')
 SELECT l.c, coalesce(l.id, r.id) AS id, r.price FROM l LEFT JOIN r ON l.c = r.c AND (l.id = r.id OR l.id IS NULL)""",
)
def _e4_twice(t: Tables):
    customer, orders = _customer_orders(t)
    first = a.optional(customer, orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000))).select("c", "id")
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    second = urgent.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.optional(first, second, maybe=["id"], maybe_right=[])


@query(
    "E4_optional_filter_unbound",
    """WITH l AS (SELECT c_custkey AS c, c_acctbal AS balance, o_orderkey AS id FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey),
 r AS (SELECT o_custkey AS c, o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT')
 SELECT l.c, coalesce(l.id, r.id) AS id, r.price FROM l LEFT JOIN r ON l.c = r.c AND (l.id = r.id OR l.id IS NULL) AND r.price > l.balance * 20""",
)
def _e4_filter_unbound(t: Tables):
    customer, orders = _customer_orders(t)
    first = a.optional(customer, orders.where(F.col("o_orderstatus") == "P")).select("c", "balance", "id")
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    second = urgent.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.optional(first, second, F.col("price") > F.col("balance") * 20, ["id"], []).select("c", "id", "price")


@query(
    "E4_optional_unrelated",
    "SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON n_nationkey > 20 AND n_nationkey * 400 > s_acctbal",
)
def _e4_unrelated(t: Tables):
    nations = t.nation.where(F.col("n_nationkey") > 20).select("n_nationkey")
    closer = F.col("n_nationkey") * 400 > F.col("s_acctbal")
    return a.optional(t.supplier.select("s_suppkey", "s_acctbal"), nations, closer).select("s_suppkey", "n_nationkey")


@query(
    "E5_union",
    """SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer WHERE c_nationkey < 5
 UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""",
)
def _e5(t: Tables):
    left = t.customer.where(F.col("c_nationkey") < 5).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.union(left, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query(
    "E6_minus",
    f"""SELECT s AS c FROM {CUSTOMER_SQL} WHERE p = '{vocab.RDF_TYPE}' AND s NOT IN (SELECT {node('customer', 'o_custkey')} FROM orders WHERE o_orderstatus = 'P')""",
)
def _e6(t: Tables):
    busy = t.orders.where(F.col("o_orderstatus") == "P").select(terms.iri(F.concat(F.lit("http://example.org/data/customer/"), "o_custkey")).alias("c"), "o_orderkey")
    return a.minus(p.match(customer_quads(t), Pattern("?c", vocab.RDF_TYPE, ont("Customer"))), busy)


@query("E6_minus_nothing_shared", "SELECT s_suppkey AS id FROM supplier")
def _e6_none(t: Tables):
    return a.minus(t.supplier.select(F.col("s_suppkey").alias("id")), t.nation.select("n_name"))


@query(
    "E6_minus_unbound",
    """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS c FROM orders)
 SELECT id, c FROM l WHERE c IS NULL OR c NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _e6_unbound(t: Tables):
    left = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("c"))
    return a.minus(left, t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("c")), maybe=["c"], maybe_right=[])


@query("E7_filter_exists", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _e7(t: Tables):
    customer, orders = _customer_orders(t)
    return a.exists(customer.select("c"), orders.where(F.col("o_totalprice") > 400000))


@query("E7_filter_not_exists", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _e7_not(t: Tables):
    customer, orders = _customer_orders(t)
    return a.not_exists(customer.select("c"), orders.where(F.col("o_totalprice") > 400000))


@query(
    "E8_pattern_exists",
    f"""SELECT s AS n, o AS name FROM {PLACE_SQL} x WHERE p = '{ont('name')}'
 AND EXISTS (SELECT 1 FROM {CUSTOMER_SQL} c WHERE c.p = '{ont('nation')}' AND c.o = x.s)
 AND NOT EXISTS (SELECT 1 FROM supplier WHERE {node('nation', 's_nationkey')} = x.s AND s_acctbal > 9000)""",
)
def _e8(t: Tables):
    names = p.match(place_quads(t), Pattern("?n", ont("name"), "?name"))
    rich = t.supplier.where(F.col("s_acctbal") > 9000).select(terms.iri(F.concat(F.lit("http://example.org/data/nation/"), "s_nationkey")).alias("n"))
    found = a.exists(names, p.match(customer_quads(t), Pattern("?c", ont("nation"), "?n")))
    return a.not_exists(found, rich)


@query(
    "E9_subquery",
    """SELECT c_name AS name, best FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY o_custkey
 ORDER BY best DESC, o_custkey LIMIT 25) ON o_custkey = c_custkey""",
)
def _e9(t: Tables):
    best = g.grouped(t.orders, [F.col("o_custkey").alias("c")], {"best": F.max("o_totalprice")})
    top = g.top(best, 25, F.col("best").desc(), F.col("c"))
    return a.join(t.customer.select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name")), top).select("name", "best")


@query(
    "E10_theta_across_windows",
    f"""SELECT tick, a.event_id AS first, b.event_id AS second FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(6, 12)})
 JOIN events a ON a.ts >= up - INTERVAL 12 HOUR AND a.ts < up AND a.event_type = 'click'
 JOIN events b ON b.ts >= up - INTERVAL 12 HOUR AND b.ts < up AND b.event_type = 'view' AND a.user_id = b.user_id AND a.value < b.value""",
)
def _e10(t: Tables):
    ticks = event_ticks(t, 6, 12)
    win = hours(12, 1, ticks)

    def side(kind: str, name: str):
        rows = t.events.where(F.col("event_type") == kind)
        return w.spans(rows.select("ts", "user_id", F.col("event_id").alias(name), F.col("value").alias(f"v_{name}")), "ts", win, ticks).drop("ts")

    both = w.join_spans(side("click", "first"), side("view", "second"), ["user_id"], win.max_ticks(ticks))
    return w.unfold(both.where(F.col("v_first") < F.col("v_second")), ticks).select("tick", "first", "second")


@query(
    "E11_term_join",
    """SELECT p_partkey, n_name, p_size % 2 = 0 AS same_term FROM part JOIN nation ON p_size = n_nationkey""",
)
def _e11_join(t: Tables):
    # Joins compare terms: an odd size, written as a decimal, meets the integer by value only.
    size = F.col("p_size").cast("string")
    written = F.when(F.col("p_size") % 2 == 0, terms.typed(size, vocab.XSD + "integer")).otherwise(
        terms.typed(F.concat(size, F.lit(".0")), vocab.XSD + "decimal")
    )
    parts = t.part.select("p_partkey", written.alias("n"), terms.num(written).alias("value"))
    nations = t.nation.select("n_name", terms.typed(F.col("n_nationkey").cast("string"), vocab.XSD + "integer").alias("n"))
    by_term = a.join(parts.select("p_partkey", "n"), nations).select("p_partkey", "n_name", F.lit(True).alias("same_term"))
    by_value = a.join(parts.select("p_partkey", "value"), nations.select("n_name", terms.num(F.col("n")).alias("value")))
    others = a.not_exists(by_value, by_term.select("p_partkey", "n_name"))
    return by_term.unionByName(others.select("p_partkey", "n_name", F.lit(False).alias("same_term")))


@query(
    "E11_term_identity",
    """SELECT CAST(count(*) AS BIGINT) AS by_term, (SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_size > 0) AS by_value
 FROM part WHERE p_size > 0 AND p_size % 2 = 0""",
)
def _e11(t: Tables):
    # The same number as an integer and, for odd sizes, as a decimal: different terms, equal values.
    integer = terms.typed(F.col("p_size").cast("string"), vocab.XSD + "integer")
    mixed = F.when(F.col("p_size") % 2 == 0, integer).otherwise(
        terms.typed(F.concat(F.col("p_size").cast("string"), F.lit(".0")), vocab.XSD + "decimal")
    )
    pairs = t.part.where(F.col("p_size") > 0).select(integer.alias("x"), mixed.alias("y"))
    same = F.count(F.when(F.col("x") == F.col("y"), 1))
    equal = F.count(F.when(terms.num(F.col("x")) == terms.num(F.col("y")), 1))
    return pairs.agg(same.alias("by_term"), equal.alias("by_value"))
