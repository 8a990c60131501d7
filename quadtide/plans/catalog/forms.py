"""Registered queries: query forms (G) and updates (I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.operators import forms as f
from quadtide.operators import patterns as p
from quadtide.operators import quads as q
from quadtide.operators.patterns import Pattern, Quoted
from quadtide.plans.catalog import query
from quadtide.plans.catalog.views import CUSTOMER_SQL, DATA, PLACE_SQL, customer_quads, node, ont, place_quads
from quadtide.session import fresh_path
from quadtide.sources import sinks, trig
from quadtide.sources.tables import Tables


@query(
    "G1_select",
    f"SELECT a.o AS name, b.o AS segment FROM {CUSTOMER_SQL} a JOIN {CUSTOMER_SQL} b USING (s) WHERE a.p = '{ont('name')}' AND b.p = '{ont('segment')}'",
)
def _g1(t: Tables):
    found = p.basic_pattern(customer_quads(t), [Pattern("?c", ont("name"), "?name"), Pattern("?c", ont("segment"), "?segment")])
    return found.select("name", "segment")


@query(
    "G2_construct",
    f"""WITH named AS (SELECT g, s AS n, o AS name FROM {PLACE_SQL} WHERE p = '{ont('name')}' AND g <> 'urn:default')
 SELECT g, n AS s, '{ont('label')}' AS p, name AS o, CAST(1 AS BIGINT) AS n FROM named
 UNION ALL SELECT 'urn:default', '<< ' || n || ' {ont('label')} ' || name || ' >>', '{ont('statedIn')}', g, 1 FROM named
 UNION ALL SELECT 'urn:default', 'blank', '{ont('about')}', n, 1 FROM named""",
)
def _g2(t: Tables):
    named = p.match(p.in_graph(place_quads(t), "?g"), Pattern("?n", ont("name"), "?name", "?g"))
    built = f.construct(named, [
        ("?n", ont("label"), "?name", "?g"),
        (Quoted("?n", ont("label"), "?name"), ont("statedIn"), "?g"),
        ("_:note", ont("about"), "?n"),
        ("?name", ont("illFormed"), "?n"),
    ])
    shown = built.withColumn("s", F.when(terms.is_blank(F.col("s")), "blank").otherwise(F.col("s")))
    return shown.groupBy(*q.KEY).agg(F.count(F.lit(1)).alias("n"))


@query("G3_ask", "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 499000 AND o_orderpriority = '1-URGENT'")
def _g3(t: Tables):
    return f.ask(t.orders.where((F.col("o_totalprice") > 499000) & (F.col("o_orderpriority") == "1-URGENT")))


@query(
    "G4_describe",
    """SELECT conv_id, CAST(count(*) + 1 AS BIGINT) AS statements FROM conversations WHERE conv_id IN (
 SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user') GROUP BY conv_id""",
)
def _g4(t: Tables):
    # Conversation -> blank turn -> next blank turn: the description follows the blank nodes.
    turns = t.conversations.select("conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    turn = lambda n: terms.bnode(F.concat_ws("x", "conv_id", n))
    head = turns.where(F.col("turn") == 0)
    conversation = q.subject(DATA + "conversation/%s", F.col("conv_id"))
    quads = head.select(conversation.alias("s"), F.lit(ont("first")).alias("p"), turn(F.lit(0)).alias("o"), "conv_id")
    nexts = turns.where(F.col("turn") > 0).select(turn(F.col("turn") - 1).alias("s"), F.lit(ont("next")).alias("p"), turn(F.col("turn")).alias("o"), "conv_id")
    roles = head.select(conversation.alias("s"), F.lit(ont("role")).alias("p"), terms.string(F.col("role")).alias("o"), "conv_id")
    every = reduce(DataFrame.unionByName, [quads, nexts, roles])
    wanted = head.where(F.col("role") == "user").select(conversation.alias("s"))
    return f.describe(every, wanted).groupBy("conv_id").agg(F.count(F.lit(1)).alias("statements"))


# Updates ----------------------------------------------------------------------------------------

_SUPPLIER_ROWS = f"""SELECT 'urn:default' AS g, {node('supplier', 's_suppkey')} AS s, '{ont('nation')}' AS p, {node('nation', 's_nationkey')} AS o FROM supplier"""
_PLACE = f"SELECT g, s, p, o FROM {PLACE_SQL}"


def _supplier_rows(t: Tables):
    return q.table_quads(t.supplier, q.subject(DATA + "supplier/%s", F.col("s_suppkey")), {ont("nation"): q.resource(DATA + "nation/%s", F.col("s_nationkey"))})


@query("I1_insert_data", f"{_PLACE} UNION {_SUPPLIER_ROWS}")
def _i1(t: Tables):
    once = f.insert_data(place_quads(t), _supplier_rows(t))
    return f.insert_data(once, _supplier_rows(t)).select(*q.KEY)


@query("I2_delete_data", f"SELECT g, s, p, o FROM {CUSTOMER_SQL} WHERE p <> '{ont('balance')}' AND NOT (p = '{ont('segment')}' AND o = '\"BUILDING\"')")
def _i2(t: Tables):
    quads = customer_quads(t).where(F.col("p") != ont("balance"))
    gone = quads.where((F.col("p") == ont("segment")) & (F.col("o") == '"BUILDING"'))
    return f.delete_data(quads, gone).select(*q.KEY)


@query("I3_delete_where", f"{_PLACE} WHERE NOT (p = '{ont('region')}' AND o = '<{DATA}region/2>')")
def _i3(t: Tables):
    quads = place_quads(t)
    found = p.match(quads, Pattern("?n", ont("region"), f"<{DATA}region/2>", "?g"))
    return f.delete_where(quads, found, [("?n", ont("region"), f"<{DATA}region/2>", "?g")]).select(*q.KEY)


@query(
    "I4_modify",
    f"""{_PLACE} WHERE NOT (p = '{ont('name')}' AND g = '<{DATA}graph/1>')
 UNION SELECT g, s, '{ont('label')}', o FROM {PLACE_SQL} WHERE p = '{ont('name')}' AND g = '<{DATA}graph/1>'""",
)
def _i4(t: Tables):
    quads, graph = place_quads(t), f"<{DATA}graph/1>"
    found = p.match(p.in_graph(quads, graph), Pattern("?n", ont("name"), "?name"))
    return f.modify(quads, found, [("?n", ont("name"), "?name")], [("?n", ont("label"), "?name")], with_graph=graph).select(*q.KEY)


@query("I5_load_into_graph", f"{_PLACE} UNION SELECT '<{DATA}graph/loaded>', s, p, o FROM ({_SUPPLIER_ROWS})")
def _i5(t: Tables):
    path = fresh_path(t.spark, "load")
    sinks.write_statements(_supplier_rows(t), path)
    loaded = trig.read_dataset(t.spark, path, prefixes={}, unit="line")
    return trig.load_into(place_quads(t), loaded, f"<{DATA}graph/loaded>").select(*q.KEY)


_CLEAR_SQL = f"""SELECT 'one' AS what, CAST(count(*) AS BIGINT) AS left_over FROM {PLACE_SQL} WHERE g <> '<{DATA}graph/4>'
 UNION ALL SELECT 'DEFAULT', CAST(count(*) AS BIGINT) FROM {PLACE_SQL} WHERE g <> 'urn:default'
 UNION ALL SELECT 'NAMED', CAST(count(*) AS BIGINT) FROM {PLACE_SQL} WHERE g = 'urn:default'
 UNION ALL SELECT 'ALL', CAST(0 AS BIGINT)"""


@query("I6_clear", _CLEAR_SQL)
def _i6(t: Tables):
    quads = place_quads(t)
    targets = {"one": f"<{DATA}graph/4>", "DEFAULT": "DEFAULT", "NAMED": "NAMED", "ALL": "ALL"}
    counts = [f.clear(quads, g).agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("left_over")) for n, g in targets.items()]
    return reduce(DataFrame.unionByName, counts)


_A, _B = f"<{DATA}graph/0>", f"<{DATA}graph/1>"
_SOURCE = f"SELECT '{_B}' AS g, s, p, o FROM {PLACE_SQL} WHERE g = '{_A}'"


@query(
    "I8_add_copy_move",
    f"""SELECT 'add' AS op, * FROM ({_PLACE} UNION {_SOURCE})
 UNION ALL SELECT 'copy', * FROM ({_PLACE} WHERE g <> '{_B}' UNION {_SOURCE})
 UNION ALL SELECT 'move', * FROM ({_PLACE} WHERE g NOT IN ('{_A}', '{_B}') UNION {_SOURCE})""",
)
def _i8(t: Tables):
    quads = place_quads(t).select(*q.KEY)
    done = {"add": f.add_graph(quads, _A, _B), "copy": f.copy_graph(quads, _A, _B), "move": f.move_graph(quads, _A, _B)}
    return reduce(DataFrame.unionByName, [d.withColumn("op", F.lit(n)) for n, d in done.items()])


