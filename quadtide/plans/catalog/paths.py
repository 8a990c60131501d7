"""Registered queries: property paths (H), over conversation turns and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.operators import paths as h
from quadtide.operators import quads as q
from quadtide.plans.catalog import query
from quadtide.plans.catalog.views import CUSTOMER_SQL, DATA, PLACE_SQL, customer_quads, ont, place_quads
from quadtide.sources.tables import Tables

_NEXT = ont("next")
_EDGES = f"""(SELECT '<{DATA}turn/' || a.conv_id || '-' || a.turn || '>' AS x, '<{DATA}turn/' || b.conv_id || '-' || b.turn || '>' AS y
 FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turns(t: Tables):
    """Statements ``turn n :next turn n+1``."""
    turn = t.conversations.select("conv_id", "turn").distinct()
    after = turn.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = turn.join(after, ["conv_id", "turn"])
    name = lambda n: F.concat_ws("-", "conv_id", n)
    return q.table_quads(pairs, q.subject(DATA + "turn/%s", name(F.col("turn"))), {_NEXT: q.resource(DATA + "turn/%s", name(F.col("turn") + 1))})


def _next(t: Tables):
    return h.step(_turns(t), _NEXT)


@query("H1_sequence", f"SELECT c.s AS customer, n.o AS region FROM {CUSTOMER_SQL} c JOIN {PLACE_SQL} n ON n.s = c.o AND n.p = '{ont('region')}' WHERE c.p = '{ont('nation')}'")
def _h1(t: Tables):
    path = h.sequence(h.step(customer_quads(t), ont("nation")), h.step(place_quads(t), ont("region")))
    return h.from_each(path, ("customer", "region"))


@query("H2_inverse", f"SELECT o AS nation, s AS customer FROM {CUSTOMER_SQL} WHERE p = '{ont('nation')}'")
def _h2(t: Tables):
    return h.from_each(h.inverse(h.step(customer_quads(t), ont("nation"))), ("nation", "customer"))


@query("H3_alternative", f"SELECT s AS x, o AS y FROM {CUSTOMER_SQL} WHERE p IN ('{ont('name')}', '{ont('segment')}')")
def _h3(t: Tables):
    return h.any_of(customer_quads(t), [ont("name"), ont("segment")])


@query("H4_zero_or_one", f"SELECT x, y FROM {_EDGES} UNION SELECT x, x FROM {_EDGES} UNION SELECT y, y FROM {_EDGES}")
def _h4(t: Tables):
    return h.zero_or_one(_next(t), h.nodes(_turns(t)))


_CLOSURE = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"


@query("H5_one_or_more", f"{_CLOSURE} SELECT x, y FROM r")
def _h5(t: Tables):
    return h.one_or_more(_next(t))


@query("H5_zero_or_more", f"{_CLOSURE} SELECT x, y FROM r UNION SELECT x, x FROM e UNION SELECT y, y FROM e")
def _h5_star(t: Tables):
    quads = _turns(t)
    return h.zero_or_more(h.step(quads, _NEXT), h.nodes(quads))


_AFTER = f"SELECT a.p_partkey AS part, b.p_partkey AS later FROM part a JOIN part b ON a.p_partkey < b.p_partkey"


def _parts_in_order(t: Tables):
    """One chain of all parts: each leads to the next key."""
    part = lambda n: F.col("p_partkey") + n
    pairs = t.part.select(part(0).alias("x"), part(1).alias("y"))
    return pairs.join(t.part.select(part(0).alias("y")), "y", "left_semi").select("x", "y")


@query(
    "H5_long_chain",
    f"SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(max(later - part) AS INTEGER) AS longest FROM ({_AFTER}) GROUP BY part",
)
def _h5_chain(t: Tables):
    return h.reach_counts(_parts_in_order(t)).withColumnRenamed("x", "part")


@query("H6_long_chain", f"SELECT part, CAST(count(*) AS BIGINT) AS n FROM ({_AFTER}) WHERE later >= part + 3 GROUP BY part")
def _h6_chain(t: Tables):
    return h.at_least_counts(_parts_in_order(t), 3).withColumnRenamed("x", "part")


@query(
    "H6_counted_range",
    f"""WITH e AS (SELECT * FROM {_EDGES}) SELECT a.x, b.y FROM e a JOIN e b ON a.y = b.x
 UNION ALL SELECT a.x, c.y FROM e a JOIN e b ON a.y = b.x JOIN e c ON b.y = c.x""",
)
def _h6(t: Tables):
    return h.between_times(_next(t), 2, 3)


@query("H6_at_least", f"{_CLOSURE} SELECT r.x, e.y FROM r JOIN e ON r.y = e.x")
def _h6_least(t: Tables):
    # Turns form chains, so a pair has one path and the bag equals the set.
    return h.at_least(_next(t), 2)


@query(
    "H7_negated_set",
    f"""SELECT s AS x, o AS y FROM {PLACE_SQL} WHERE p NOT IN ('{ont('name')}')
 UNION ALL SELECT o AS x, s AS y FROM {PLACE_SQL} WHERE p NOT IN ('{ont('region')}')""",
)
def _h7(t: Tables):
    return h.none_of(place_quads(t), [ont("name")], [ont("region")])


@query(
    "H8_shortest",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), r AS (SELECT x, y, 1 AS length FROM e UNION SELECT r.x, e.y, length + 1 FROM r JOIN e ON r.y = e.x)
 SELECT x, y, CAST(min(length) AS INTEGER) AS length FROM r GROUP BY x, y""",
)
def _h8(t: Tables):
    return h.shortest(_next(t))


_SHARED = """(SELECT DISTINCT '<http://example.org/data/order/' || l_orderkey || '>' AS x, '<http://example.org/data/supplier/' || l_suppkey || '>' AS y FROM lineitem)"""
_SUPPLIED_IN = """(SELECT '<http://example.org/data/supplier/' || s_suppkey || '>' AS x, '<http://example.org/data/nation/' || s_nationkey || '>' AS y FROM supplier)"""


def _supply(t: Tables):
    # A statement is made of its two keys, so equal ones are found by these, which are much shorter.
    supplied = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    order = q.table_quads(
        supplied, q.subject(DATA + "order/%s", F.col("l_orderkey")), {ont("supplier"): q.resource(DATA + "supplier/%s", F.col("l_suppkey"))}
    ).select(*q.KEY)
    place = q.table_quads(
        t.supplier, q.subject(DATA + "supplier/%s", F.col("s_suppkey")), {ont("nation"): q.resource(DATA + "nation/%s", F.col("s_nationkey"))}
    ).select(*q.KEY)
    return h.sequence(h.step(order, ont("supplier")), h.step(place, ont("nation")))


@query("H8_distinct", f"SELECT DISTINCT a.x, b.y FROM {_SHARED} a JOIN {_SUPPLIED_IN} b ON a.y = b.x")
def _h8_distinct(t: Tables):
    return h.distinct(_supply(t))


@query("H8_multi", f"SELECT a.x, b.y FROM {_SHARED} a JOIN {_SUPPLIED_IN} b ON a.y = b.x")
def _h8_multi(t: Tables):
    return h.multi(_supply(t))
