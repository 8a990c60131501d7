"""Registered queries: aggregation and solution modifiers (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.functions import registry
from quadtide.functions import terms
from quadtide.operators import grouping as g
from quadtide.operators import skew
from quadtide.operators import windows as w
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.plans.catalog.views import customer_quads, event_ticks, hours, ont
from quadtide.sources.tables import Tables
from quadtide.vocab import XSD


@query(
    "F1_group_by_expressions",
    """SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n,
 round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL""",
)
def _f1(t: Tables):
    keys = [F.col("l_returnflag").alias("flag"), ("y", F.year("l_shipdate"))]
    return g.grouped(t.lineitem, keys, {"n": g.count_all(), "quantity": F.round(g.sum_(F.col("l_quantity")), 2)})


@query("F2_single_group", "SELECT CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 1000")
def _f2(t: Tables):
    return t.orders.where(F.col("o_totalprice") < 1000).agg(g.count_all().alias("n"), F.max("o_totalprice").alias("top"))


@query("F3_having", "SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _f3(t: Tables):
    return g.grouped(t.orders, [F.col("o_custkey").alias("c")], {"n": g.count_all()}, F.col("n") > 12)


@query(
    "F4_count",
    """SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS all_rows, CAST(count(CASE WHEN l_tax > 0.02 THEN l_tax END) AS BIGINT) AS taxed,
 CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT (l_suppkey, l_linenumber)) AS BIGINT) AS pairs FROM lineitem GROUP BY l_returnflag""",
)
def _f4(t: Tables):
    return g.grouped(t.lineitem, [F.col("l_returnflag").alias("flag")], {
        "all_rows": g.count_all(), "taxed": g.count(F.when(F.col("l_tax") > 0.02, F.col("l_tax"))),
        "suppliers": g.count(F.col("l_suppkey"), distinct=True), "pairs": g.count_distinct_rows(["l_suppkey", "l_linenumber"]),
    })


@query("F4_count_distinct_hot_groups", "SELECT l_linestatus AS status, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM lineitem GROUP BY l_linestatus")
def _f4_hot(t: Tables):
    return skew.count_distinct_by(t.lineitem.withColumnRenamed("l_linestatus", "status"), ["status"], ["l_orderkey"], "orders")


@query(
    "F5_sum",
    """SELECT n_name AS nation, CAST(coalesce(sum(CASE WHEN c_acctbal > 9900 THEN c_nationkey END), 0) AS DOUBLE) AS rich,
 CAST(sum(DISTINCT length(c_mktsegment)) AS DOUBLE) AS lengths FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _f5(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rich = F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey").cast("double"))
    return g.grouped(rows, [F.col("n_name").alias("nation")], {
        "rich": g.sum_(rich), "lengths": g.sum_(F.length("c_mktsegment").cast("double"), distinct=True),
    })


@query(
    "F5_sum_of_terms",
    "SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS total, NULL::DOUBLE AS names FROM customer GROUP BY c_mktsegment",
)
def _f5_terms(t: Tables):
    balance = terms.number(F.col("c_acctbal"))
    rows = t.customer.select(F.col("c_mktsegment").alias("segment"), balance.alias("b"), terms.string(F.col("c_name")).alias("n"))
    return g.grouped(rows, [F.col("segment")], {"total": F.round(g.sum_terms(F.col("b")), 2), "names": g.sum_terms(F.col("n"))})


@query(
    "F6_min_max",
    "SELECT p_brand AS brand, min(p_retailprice) AS low, max(p_retailprice) AS high, max(DISTINCT p_size) AS size FROM part GROUP BY p_brand",
)
def _f6(t: Tables):
    return g.grouped(t.part, [F.col("p_brand").alias("brand")], {
        "low": F.min("p_retailprice"), "high": F.max("p_retailprice"), "size": F.max("p_size"),
    })


@query(
    "F6_min_max_term_order",
    """SELECT p, min(o) AS least_text, max(o) AS most_text FROM (
 SELECT '<http://example.org/ontology/name>' AS p, '"' || c_name || '"' AS o FROM customer) GROUP BY p""",
)
def _f6_terms(t: Tables):
    quads = customer_quads(t).where(F.col("p") == ont("name"))
    return g.grouped(quads, [F.col("p")], {"least_text": g.min_term(F.col("o")), "most_text": g.max_term(F.col("o"))})


@query(
    "F7_avg",
    """SELECT p_type AS type, round(avg(p_retailprice), 4) AS mean, round(avg(DISTINCT p_size), 4) AS mean_size,
 CAST(coalesce(avg(CASE WHEN p_size > 1000 THEN p_size END), 0) AS DOUBLE) AS none FROM part GROUP BY p_type""",
)
def _f7(t: Tables):
    return g.grouped(t.part, [F.col("p_type").alias("type")], {
        "mean": F.round(g.avg(F.col("p_retailprice")), 4), "mean_size": F.round(g.avg(F.col("p_size"), distinct=True), 4),
        "none": g.avg(F.when(F.col("p_size") > 1000, F.col("p_size"))),
    })


@query("F8_sample", "SELECT c_nationkey AS nation, min(c_name) AS someone FROM customer GROUP BY c_nationkey")
def _f8(t: Tables):
    return g.grouped(t.customer, [F.col("c_nationkey").alias("nation")], {"someone": g.sample(F.col("c_name"))})


@query(
    "F9_group_concat",
    """SELECT o_custkey AS customer, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey::VARCHAR) AS keys,
 string_agg(o_orderstatus, ', ' ORDER BY o_orderkey DESC) AS newest_first, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses
 FROM orders GROUP BY o_custkey""",
)
def _f9(t: Tables):
    return g.grouped(t.orders, [F.col("o_custkey").alias("customer")], {
        "keys": g.group_concat(F.col("o_orderkey").cast("string")),
        "newest_first": g.group_concat(F.col("o_orderstatus"), ", ", -F.col("o_orderkey")),
        "statuses": g.group_concat(F.col("o_orderstatus"), "|", distinct=True),
    })


_SPREAD = "round({0}(l_extendedprice), 3) AS {1}"


@query(
    "F10_stdev",
    f"""SELECT l_linenumber AS line, {_SPREAD.format('stddev_samp', 'samp')}, {_SPREAD.format('stddev_pop', 'pop')},
 (SELECT round(stddev_samp(q), 6) FROM (SELECT DISTINCT l_quantity AS q FROM lineitem x WHERE x.l_linenumber = lineitem.l_linenumber)) AS distinct_samp
 FROM lineitem GROUP BY l_linenumber""",
)
def _f10(t: Tables):
    key = [F.col("l_linenumber").alias("line")]
    price = F.col("l_extendedprice")
    base = g.grouped(t.lineitem, key, {"samp": F.round(g.stdev(price), 3), "pop": F.round(g.stdev(price, True), 3)})
    rows = t.lineitem.withColumnRenamed("l_linenumber", "line")
    once = g.distinct_then(rows, ["line"], "l_quantity", {"distinct_samp": F.round(g.stdev(F.col("l_quantity")), 6)})
    return base.join(once, "line")


@query(
    "F11_variance",
    """SELECT l_linenumber AS line, round(var_samp(l_quantity), 4) AS samp, round(var_pop(l_quantity), 4) AS pop FROM lineitem GROUP BY l_linenumber""",
)
def _f11(t: Tables):
    q = F.col("l_quantity")
    return g.grouped(t.lineitem, [F.col("l_linenumber").alias("line")], {
        "samp": F.round(g.variance(q), 4), "pop": F.round(g.variance(q, True), 4),
    })


@query(
    "F12_custom_aggregate",
    "SELECT o_orderstatus AS status, round(exp(avg(ln(o_totalprice))), 2) AS geometric_mean FROM orders GROUP BY o_orderstatus",
)
def _f12(t: Tables):
    price = registry.aggregate("http://example.org/agg/geometricMean", F.col("o_totalprice"))
    return g.grouped(t.orders, [F.col("o_orderstatus").alias("status")], {"geometric_mean": F.round(price, 2)})


_TERMS = """(SELECT '<http://example.org/data/customer/' || c_custkey || '>' AS o, 2 AS kind, NULL::BIGINT AS num FROM customer
 UNION ALL SELECT '_:n' || n_nationkey, 1, NULL FROM nation
 UNION ALL SELECT '"' || p_partkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', 3, p_partkey FROM part)"""


@query(
    "F13_order_by_terms",
    f"SELECT row_number() OVER (ORDER BY kind, num, o) AS position, o FROM {_TERMS}",
)
def _f13(t: Tables):
    # The place in the order shows it in a comparison that ignores the order of rows.
    iris = t.customer.select(terms.iri(F.concat(F.lit("http://example.org/data/customer/"), "c_custkey")).alias("o"))
    blanks = t.nation.select(terms.bnode(F.concat(F.lit("n"), "n_nationkey")).alias("o"))
    numbers = t.part.select(terms.number(F.col("p_partkey"), XSD + "integer").alias("o"))
    return g.numbered(iris.unionByName(blanks).unionByName(numbers), terms.order_key(F.col("o")))


@query("F14_limit_offset", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
def _f14(t: Tables):
    return g.page(g.order_by(t.orders.select(F.col("o_orderkey").alias("id")), F.col("id")), 20, 35)


@query("F15_top_k", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _f15(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return g.top(rows, 50, F.col("price").desc(), F.col("id"))


@query(
    "F15_top_k_per_tick",
    f"""SELECT tick, event_id, value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT tick, event_id, value, row_number() OVER (PARTITION BY tick ORDER BY value DESC, event_id) AS rank
 FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(6, 12)}) JOIN events ON ts >= up - INTERVAL 12 HOUR AND ts < up) WHERE rank <= 3""",
)
def _f15_tick(t: Tables):
    ticks = event_ticks(t, 6, 12)
    rows = w.window_rows(t.events.select("ts", "event_id", "value"), "ts", hours(12, 1, ticks), ticks).drop("ts")
    return g.top_per(rows, ["tick"], 3, F.col("value").desc(), F.col("event_id"))


@query("F16_distinct", "SELECT DISTINCT l_suppkey AS s, l_returnflag AS flag FROM lineitem")
def _f16(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag")).distinct()


@query("F17_reduced", "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def _f17(t: Tables):
    return g.reduced(t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))


@query(
    "F18_aggregate_per_tick",
    f"""SELECT tick, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 8) AS mean, max(value) AS top
 FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(2, 12)}) JOIN events ON ts >= up - INTERVAL 12 HOUR AND ts < up
 GROUP BY ALL HAVING avg(value) > 45""",
)
def _f18(t: Tables):
    ticks = event_ticks(t, 2, 12)
    aggs = {"n": ("count", F.lit(1)), "mean": ("avg", F.col("value")), "top": ("max", F.col("value"))}
    out = w.sliding_aggregate(t.events, "ts", hours(12, 1, ticks), ticks, ["event_type"], aggs)
    return out.where(F.col("mean") > 45).withColumn("mean", F.round("mean", 8))


@query(
    "F18_aggregate_over_long_windows",
    f"""SELECT tick, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total, round(sum(value), 3) / count(*) AS mean,
  min(value) AS low, max(value) AS top
 FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(1, 240)}) JOIN events ON ts >= up - INTERVAL 240 HOUR AND ts < up GROUP BY ALL""",
)
def _f18_long(t: Tables):
    # Every row is seen by 240 ticks.
    ticks, value = event_ticks(t, 1, 240), F.col("value")
    aggs = {"n": ("count", F.lit(1)), "total": ("sum", value), "low": ("min", value), "top": ("max", value)}
    out = w.sliding_aggregate(t.events, "ts", hours(240, 1, ticks), ticks, ["event_type"], aggs)
    return out.withColumn("total", F.round("total", 3)).withColumn("mean", F.col("total") / F.col("n"))
