"""Observation streams and statement tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let
from quadtide.operators import quads as q
from quadtide.operators.windows import Ticks, TimeWindow
from quadtide.sources.tables import Tables

# One event type per observation stream.
STREAM_TYPES = {"low1": "signup", "low2": "click", "high1": "view", "high2": "purchase"}


def reading(t: Tables, name: str, annotated: bool | None = None) -> DataFrame:
    """Readings of one stream; streams "2" carry an error literal per reading."""
    annotated = name.endswith("2") if annotated is None else annotated
    df = t.events.where(F.col("event_type") == STREAM_TYPES[name])
    out = df.select("ts", "event_id", F.col("user_id").alias("place"), "value", "props")
    if annotated:
        k = F.get_json_object("props", "$.k")
        out = let(out, unc=u.parse(F.concat(F.lit("N(0,"), k, F.lit(".5)"))))
    return out.drop("props")


# SQL of the annotated readings, matching ``reading`` above.
def reading_sql(name: str) -> str:
    error = ", 'N' AS kind, CAST(0 AS DOUBLE) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 AS b"
    return (
        f"(SELECT ts, event_id, user_id AS place, value{error if name.endswith('2') else ''} "
        f"FROM events WHERE event_type = '{STREAM_TYPES[name]}')"
    )


def hours(range_: int, step: int, ticks: Ticks) -> TimeWindow:
    return TimeWindow(range_ * 3_600_000_000, step * 3_600_000_000, ticks.start)


def event_ticks(t: Tables, every: int, tail: int) -> Ticks:
    return Ticks.covering(t.events, "ts", f"PT{every}H", f"PT{tail}H")


# Statement views ------------------------------------------------------------------------------

DATA = "http://example.org/data/"
ONT = "http://example.org/ontology/"


def ont(name: str) -> str:
    return f"<{ONT}{name}>"


def node(kind: str, key: str) -> str:
    """SQL text of the IRI of one row."""
    return f"('<{DATA}{kind}/' || {key} || '>')"


def place_quads(t: Tables) -> DataFrame:
    """Places and who is there: nations in the named graph of their region, suppliers spread over the
    same graphs, regions in the default one."""
    region = q.table_quads(
        t.region, q.subject(DATA + "region/%s", F.col("r_regionkey")),
        {vocab.RDF_TYPE: q.term_value(F.lit(ont("Region"))), ont("name"): q.text_value(F.col("r_name"))},
    )
    nation = q.table_quads(
        t.nation, q.subject(DATA + "nation/%s", F.col("n_nationkey")),
        {
            vocab.RDF_TYPE: q.term_value(F.lit(ont("Nation"))), ont("name"): q.text_value(F.col("n_name")),
            ont("region"): q.resource(DATA + "region/%s", F.col("n_regionkey")),
        },
        g=q.subject(DATA + "graph/%s", F.col("n_regionkey")),
    )
    supplier = q.table_quads(
        t.supplier, q.subject(DATA + "supplier/%s", F.col("s_suppkey")),
        {
            vocab.RDF_TYPE: q.term_value(F.lit(ont("Supplier"))), ont("name"): q.text_value(F.col("s_name")),
            ont("basedIn"): q.resource(DATA + "nation/%s", F.col("s_nationkey")),
        },
        g=q.subject(DATA + "graph/%s", F.col("s_nationkey") % 5),
    )
    return region.unionByName(nation).unionByName(supplier)


PLACE_SQL = f"""(
 SELECT 'urn:default' AS g, {node('region', 'r_regionkey')} AS s, '{vocab.RDF_TYPE}' AS p, '{ont('Region')}' AS o FROM region
 UNION ALL SELECT 'urn:default', {node('region', 'r_regionkey')}, '{ont('name')}', '"' || r_name || '"' FROM region
 UNION ALL SELECT {node('graph', 'n_regionkey')}, {node('nation', 'n_nationkey')}, '{vocab.RDF_TYPE}', '{ont('Nation')}' FROM nation
 UNION ALL SELECT {node('graph', 'n_regionkey')}, {node('nation', 'n_nationkey')}, '{ont('name')}', '"' || n_name || '"' FROM nation
 UNION ALL SELECT {node('graph', 'n_regionkey')}, {node('nation', 'n_nationkey')}, '{ont('region')}', {node('region', 'n_regionkey')} FROM nation
 UNION ALL SELECT {node('graph', '(s_nationkey % 5)')}, {node('supplier', 's_suppkey')}, '{vocab.RDF_TYPE}', '{ont('Supplier')}' FROM supplier
 UNION ALL SELECT {node('graph', '(s_nationkey % 5)')}, {node('supplier', 's_suppkey')}, '{ont('name')}', '"' || s_name || '"' FROM supplier
 UNION ALL SELECT {node('graph', '(s_nationkey % 5)')}, {node('supplier', 's_suppkey')}, '{ont('basedIn')}', {node('nation', 's_nationkey')} FROM supplier)"""


def customer_quads(t: Tables) -> DataFrame:
    return q.table_quads(
        t.customer, q.subject(DATA + "customer/%s", F.col("c_custkey")),
        {
            vocab.RDF_TYPE: q.term_value(F.lit(ont("Customer"))), ont("name"): q.text_value(F.col("c_name")),
            ont("nation"): q.resource(DATA + "nation/%s", F.col("c_nationkey")),
            ont("balance"): q.double_value(F.col("c_acctbal")), ont("segment"): q.text_value(F.col("c_mktsegment")),
        },
    )


# Without the canonical text of doubles: ``o`` of a balance is NULL, its number is in o_num.
CUSTOMER_SQL = f"""(
 SELECT 'urn:default' AS g, {node('customer', 'c_custkey')} AS s, '{vocab.RDF_TYPE}' AS p, '{ont('Customer')}' AS o, NULL::DOUBLE AS o_num FROM customer
 UNION ALL SELECT 'urn:default', {node('customer', 'c_custkey')}, '{ont('name')}', '"' || c_name || '"', NULL FROM customer
 UNION ALL SELECT 'urn:default', {node('customer', 'c_custkey')}, '{ont('nation')}', {node('nation', 'c_nationkey')}, NULL FROM customer
 UNION ALL SELECT 'urn:default', {node('customer', 'c_custkey')}, '{ont('balance')}', NULL, c_acctbal FROM customer
 UNION ALL SELECT 'urn:default', {node('customer', 'c_custkey')}, '{ont('segment')}', '"' || c_mktsegment || '"', NULL FROM customer)"""


def event_quads(t: Tables, annotated: bool = True, where=None) -> DataFrame:
    """Every event as a stream element: its observation graph, and its time in the default graph."""
    df = t.events if where is None else t.events.where(where)
    k = F.get_json_object("props", "$.k")
    unc = F.concat(F.lit('"N(0,'), k, F.lit(f'.5)"^^<{vocab.DISTRIBUTION}>'))
    graph = q.subject(DATA + "graph/%s", F.col("event_id"))
    return q.table_quads(
        df, q.subject(DATA + "observation/%s", F.col("event_id")),
        {
            vocab.RDF_TYPE: q.term_value(F.concat(F.lit("<" + ONT), "event_type", F.lit(">"))),
            vocab.FEATURE: q.resource(DATA + "place/%s", F.col("user_id")),
            vocab.HAS_RESULT: q.double_value(F.col("value")),
        },
        g=graph, annotations={vocab.HAS_RESULT: {vocab.UNCERTAINTY: q.term_value(unc)}} if annotated else None,
        keep=["event_id", "ts"],
        also=[(F.lit(vocab.DEFAULT_GRAPH), graph, vocab.GENERATED_AT, q.time_value(F.col("ts")))],
    ).withColumnRenamed("event_id", "elem_id")
