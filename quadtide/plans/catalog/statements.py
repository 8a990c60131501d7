"""Registered queries: sources, sinks, statement tables and patterns (A, B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import terms
from quadtide.operators import forms
from quadtide.operators import patterns as p
from quadtide.operators import quads as q
from quadtide.operators.patterns import Pattern, Quoted
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.plans.catalog.views import (
    CUSTOMER_SQL, DATA, ONT, PLACE_SQL, customer_quads, event_quads, event_ticks, hours, node, ont, place_quads,
)
from quadtide.session import fresh_path
from quadtide.streaming import runner
from quadtide.sources import sinks, trig
from quadtide.sources.tables import Tables
from quadtide.operators.windows import Ticks, micros, window_rows

_HEADER = (
    f"@prefix rdf: <{vocab.RDF}> . @prefix sosa: <{vocab.SOSA}> . @prefix prov: <{vocab.PROV}> . "
    f"@prefix xsd: <{vocab.XSD}> . @prefix unc: <{vocab.UNC}> . @prefix : <{ONT}> . @base <{DATA}> ."
)
_PREFIXES = {
    "rdf": vocab.RDF, "sosa": vocab.SOSA, "prov": vocab.PROV, "xsd": vocab.XSD, "unc": vocab.UNC, "": ONT,
}


def _write_lines(t: Tables, lines: DataFrame, label: str) -> str:
    """Text files with the declarations in a file of their own, as a stream folder has them."""
    path = fresh_path(t.spark, label)
    head = t.spark.createDataFrame([(_HEADER,)], "value string")
    lines.select("value").unionByName(head).write.text(path)
    return path


@query(
    "A1_load_static",
    f"""SELECT {node('customer', 'c_custkey')} AS s, c_name AS name, c_acctbal AS balance,
 {node('nation', 'c_nationkey')} AS nation FROM customer""",
)
def _a1(t: Tables):
    text = F.format_string(
        "<customer/%s> a :Customer ;\n  :name \"%s\" ; :balance \"%s\"^^xsd:double ;\n  :nation <nation/%s> .",
        F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal").cast("string"), F.col("c_nationkey"),
    )
    path = _write_lines(t, t.customer.select(text.alias("value")), "static")
    loaded = trig.read_dataset(t.spark, path)
    cols = {"name": (ont("name"), "o"), "balance": (ont("balance"), "o_num"), "nation": (ont("nation"), "o")}
    return q.wide_rows(loaded, cols, ["s"]).withColumn("name", terms.lex(F.col("name")))


@query(
    "A1_blocks_over_many_lines",
    f"""SELECT {node('graph', 'o_orderkey')} AS g, count(*) AS lines, sum(l_quantity) AS quantity, min(length(note)) AS note FROM (
 SELECT o_orderkey, l_quantity, 'Order ' || o_orderkey || chr(10) || 'is ' || o_orderstatus || '. ' || chr(10) || '}} End.' AS note
 FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) ON l_orderkey = o_orderkey) GROUP BY o_orderkey""",
)
def _a1_blocks(t: Tables):
    # An order is a block of several lines, with a literal that holds line ends, dots and a brace; half of
    # the lines end with a carriage return.
    row = F.format_string("  :line%s :quantity \"%s\"^^xsd:double .", F.col("l_linenumber"), F.col("l_quantity").cast("string"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\r\n").alias("lines"))
    note = F.format_string('  :note :says """Order %s\nis %s. \n} End.""" .', F.col("o_orderkey"), F.col("o_orderstatus"))
    block = F.concat_ws("\n", F.format_string("GRAPH <graph/%s>\n{ # items.", F.col("o_orderkey")), F.col("lines"), note, F.lit("}"))
    text = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(block.alias("value"))
    quads = trig.read_dataset(t.spark, _write_lines(t, text, "blocks"), base=DATA)
    quantity, note = F.col("p") == ont("quantity"), F.when(F.col("p") == ont("says"), F.length(terms.lex(F.col("o"))))
    found = quads.groupBy("g").agg(F.count(F.when(quantity, 1)).alias("lines"), F.sum(F.when(quantity, F.col("o_num"))).alias("quantity"), F.min(note).alias("note"))
    return found.withColumn("note", F.col("note").cast("long"))


def _element_lines(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value = F.col("value").cast("string")
    text = F.format_string(
        "GRAPH <graph/%s> { <observation/%s> a sosa:Observation ; sosa:hasFeatureOfInterest <place/%s> ; "
        "sosa:hasSimpleResult \"%s\"^^xsd:double . << <observation/%s> sosa:hasSimpleResult \"%s\"^^xsd:double >> "
        "unc:uncertainty \"N(0,%s.5)\"^^unc:distribution . } <graph/%s> prov:generatedAtTime \"%sZ\"^^xsd:dateTime .",
        F.col("event_id"), F.col("event_id"), F.col("user_id"), value, F.col("event_id"), value, k, F.col("event_id"), time,
    )
    return t.events.select(text.alias("value"))


_A2_SQL = f"""SELECT ts AS elem_ts, {node('observation', 'event_id')} AS obs, {node('place', 'user_id')} AS place, value,
 'N(0,' || json_extract_string(props, '$.k') || '.5)' AS unc FROM events"""


def _fold(elements: DataFrame) -> DataFrame:
    # One element carries one observation, so its statements fold into a row without a join.
    plain = F.col("s_t").isNull()
    # Sorted by time first: names of elements have their beginnings in common, which Spark compares before the rest.
    fold = elements.groupBy("elem_ts", "elem_id").agg(
        F.max(F.when(plain & (F.col("p") == vocab.FEATURE), F.col("s"))).alias("obs"),
        F.max(F.when(F.col("p") == vocab.FEATURE, F.col("o"))).alias("place"),
        F.max(F.when(F.col("p") == vocab.HAS_RESULT, F.col("o_num"))).alias("value"),
        F.max(F.when(F.col("p") == vocab.UNCERTAINTY, terms.lex(F.col("o")))).alias("unc"),
    )
    return fold.select("elem_ts", "obs", "place", "value", "unc")


@query("A2_stream_from_files", _A2_SQL)
def _a2(t: Tables):
    return _fold(trig.read_elements(t.spark, _write_lines(t, _element_lines(t), "stream")))


@query("A2_stream_from_files_streaming", _A2_SQL)
def _a2_stream(t: Tables):
    path = _write_lines(t, _element_lines(t), "stream")
    elements = trig.stream_elements(t.spark, path, _PREFIXES, DATA)
    wanted = elements.where(F.col("p").isin(vocab.FEATURE, vocab.HAS_RESULT, vocab.UNCERTAINTY))
    return _fold(runner.drain(t.spark, wanted.select("elem_id", "elem_ts", "s", "p", "o", "o_num", "s_t"), "elements"))


@query("A5_element_time", "SELECT event_id AS elem_id, ts AS elem_ts FROM events")
def _a5(t: Tables):
    return q.element_times(event_quads(t).drop("ts"))


@query(
    "A6_assert_embedded",
    f"""SELECT {node('graph', 'event_id')} AS g, 'triple' AS s_kind, '{ont('source')}' AS p, NULL::DOUBLE AS o_num FROM events
 UNION ALL SELECT {node('graph', 'event_id')}, 'triple', '{vocab.UNCERTAINTY}', NULL FROM events
 UNION ALL SELECT {node('graph', 'event_id')}, 'iri', '{vocab.HAS_RESULT}', value FROM events""",
)
def _a6(t: Tables):
    inner = terms.triple(
        q.subject(DATA + "observation/%s", F.col("event_id")), F.lit(vocab.HAS_RESULT), terms.number(F.col("value"))
    )
    unc = terms.typed(F.concat(F.lit("N(0,"), F.get_json_object("props", "$.k"), F.lit(")")), vocab.DISTRIBUTION)
    outer = t.events.select(
        q.subject(DATA + "graph/%s", F.col("event_id")).alias("g"),
        terms.triple(inner, F.lit(vocab.UNCERTAINTY), unc).alias("s"), F.lit(ont("source")).alias("p"),
        q.subject(DATA + "place/%s", F.col("user_id")).alias("o"),
    )
    every = q.assert_embedded(outer)
    return every.select("g", terms.kind(F.col("s")).alias("s_kind"), "p", "o_num")


_LEVELS = [f"about{n}" for n in range(6)]


@query(
    "A6_assert_nested_deeply",
    " UNION ALL ".join(
        f"SELECT {node('graph', 'event_id')} AS g, '{ont(p)}' AS p, {node('place', 'user_id')} AS o FROM events" for p in _LEVELS
    ) + f" UNION ALL SELECT {node('graph', 'event_id')}, '{vocab.UNCERTAINTY}', {node('place', 'user_id')} FROM events",
)
def _a6_deep(t: Tables):
    # Statements about statements: the subject of the outermost one is nested six levels deep.
    place = q.subject(DATA + "place/%s", F.col("user_id"))
    about = q.subject(DATA + "observation/%s", F.col("event_id"))
    for p in _LEVELS:
        about = terms.triple(about, F.lit(ont(p)), place)
    outer = t.events.select(q.subject(DATA + "graph/%s", F.col("event_id")).alias("g"), about.alias("s"), F.lit(vocab.UNCERTAINTY).alias("p"), place.alias("o"))
    return q.assert_embedded(outer).select("g", "p", "o")


@query(
    "A7_set_semantics_size",
    """SELECT CAST(count(*) AS BIGINT) AS size FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""",
)
def _a7(t: Tables):
    supply = q.table_quads(
        t.lineitem, q.subject(DATA + "order/%s", F.col("l_orderkey")),
        {ont("supplier"): q.resource(DATA + "supplier/%s", F.col("l_suppkey"))},
    )
    return q.distinct_quads(supply.select(*q.KEY)).agg(F.count(F.lit(1)).alias("size"))


@query("A8_table_to_statements", f"SELECT g, s, p, o, o_num FROM {CUSTOMER_SQL} UNION ALL SELECT g, s, p, o, NULL FROM {PLACE_SQL}")
def _a8(t: Tables):
    every = customer_quads(t).unionByName(place_quads(t))
    return every.select("g", "s", "p", F.when(F.col("o_num").isNull(), F.col("o")).alias("o"), "o_num")


@query(
    "A9_statements_to_rows",
    f"""SELECT {node('customer', 'c_custkey')} AS s, '"' || c_name || '"' AS name, c_acctbal AS balance,
 '"' || c_mktsegment || '"' AS segment FROM customer""",
)
def _a9(t: Tables):
    cols = {"name": (ont("name"), "o"), "balance": (ont("balance"), "o_num"), "segment": (ont("segment"), "o")}
    return q.wide_rows(customer_quads(t), cols).drop("g")


@query(
    "A10_write_and_read_statements",
    f"""SELECT {node('graph', 'event_id')} AS g, {node('observation', 'event_id')} AS inner_s, value, value AS about,
 'N(0,' || json_extract_string(props, '$.k') || '.5)' AS unc FROM events""",
)
def _a10(t: Tables):
    path = fresh_path(t.spark, "statements")
    sinks.write_statements(event_quads(t), path)
    back = trig.read_dataset(t.spark, path, prefixes={}, unit="line", labels="dataset")
    value = F.max(F.when(F.col("p") == vocab.HAS_RESULT, F.col("o_num")))
    about = back.where(F.col("g") != vocab.DEFAULT_GRAPH).groupBy("g").agg(
        F.max("s_t.s").alias("inner_s"), value.alias("value"), F.max(terms.num(F.col("s_t.o"))).alias("about"),
        F.max(F.when(F.col("s_t").isNotNull(), terms.lex(F.col("o")))).alias("unc"),
    )
    return about


@query("A11_write_table", "SELECT CAST(p_partkey AS VARCHAR) AS part, CASE WHEN p_size > 10 THEN p_name END AS name FROM part")
def _a11(t: Tables):
    path = fresh_path(t.spark, "table")
    rows = t.part.select(F.col("p_partkey").alias("part"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"))
    sinks.write_table(rows, path)
    return t.spark.read.schema("part string, name string").option("sep", "\t").option("header", True).option(
        "nullValue", "null"
    ).csv(path)


@query(
    "A12_execution_summary",
    f"""WITH tk AS (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(6, 6)}),
 ev AS (SELECT tick, CAST(row_number() OVER (ORDER BY tick) AS BIGINT) AS number FROM tk),
 m AS (SELECT number, CAST(count(*) AS BIGINT) AS results, CAST(max(event_id) - min(event_id) AS BIGINT) AS duration
  FROM tk JOIN ev USING (tick) JOIN events ON ts >= up - INTERVAL 6 HOUR AND ts < up GROUP BY number)
SELECT round(avg(duration), 6) AS duration_avg, min(duration) AS duration_min, max(duration) AS duration_max,
 round(avg(results), 6) AS results_avg, CAST(count(*) AS BIGINT) AS evaluations,
 string_agg(CAST(duration AS VARCHAR), ', ' ORDER BY number) AS durations, 'click' AS label
FROM m WHERE number > 5 AND number <= 25""",
)
def _a12(t: Tables):
    ticks = event_ticks(t, 6, 6)
    rows = window_rows(t.events.select("ts", "event_id"), "ts", hours(6, 1, ticks), ticks)
    per = rows.groupBy("tick").agg(
        F.count(F.lit(1)).alias("results"), (F.max("event_id") - F.min("event_id")).alias("duration")
    )
    number = F.call_function("div", F.unix_micros("tick") - F.lit(ticks.start), F.lit(ticks.every)) + 1
    out = sinks.execution_summary(per.withColumn("number", number), 5, 20, {"label": "click"})
    return out.withColumns({c: F.round(c, 6) for c in ("duration_avg", "results_avg")})


@query(
    "A14_construct_to_stream",
    f"""SELECT elem, g, s, p FROM (
 SELECT {node('graph', 'event_id')} AS elem, {node('graph', 'event_id')} AS g, {node('observation', 'event_id')} AS s, '{ont('reported')}' AS p FROM events WHERE value > 60
 UNION ALL SELECT {node('graph', 'event_id')}, 'urn:default', {node('graph', 'event_id')}, '{vocab.GENERATED_AT}' FROM events WHERE value > 60)""",
)
def _a14(t: Tables):
    built = event_quads(t, annotated=False)
    high = built.where((F.col("p") == vocab.HAS_RESULT) & (F.col("o_num") > 60)).withColumn("p", F.lit(ont("reported")))
    times = built.where(F.col("g") == vocab.DEFAULT_GRAPH)
    out = sinks.elements_of_graphs(high.unionByName(times).drop("elem_id", "ts"))
    return out.select(F.col("elem_id").alias("elem"), "g", "s", "p")


@query(
    "A14_constructed_stream_in_a_window",
    f"""SELECT tick, {node('place', 'user_id')} AS place, CAST(count(*) AS BIGINT) AS n, max(value) AS top
 FROM {s.ticks(2, 24)} JOIN events ON ts >= tick - INTERVAL 6 HOUR AND ts < tick WHERE value > 60 GROUP BY ALL""",
)
def _a14_chained(t: Tables):
    """A first query writes a stream of constructed elements, a second one opens windows over it."""
    high = t.stream("events").where(F.col("value") > 60)
    made = q.table_quads(
        high, q.subject(DATA + "place/%s", F.col("user_id")), {ont("reported"): q.double_value(F.col("value"))},
        g=q.subject(DATA + "graph/%s", F.col("event_id")), keep=["ts"],
    )
    elements = made.select(F.col("g").alias("elem_id"), F.col("ts").alias("elem_ts"), "g", "s", "p", "o", "o_num")
    folder, state = fresh_path(t.spark, "constructed"), fresh_path(t.spark, "constructed-state")
    runner.start(elements, folder, state).start().awaitTermination()

    ends, ticks = runner.end_folder(t.spark, "elem_ts"), Ticks(event_ticks(t, 2, 0).start, micros("PT2H"))
    again = t.spark.readStream.schema(elements.schema).parquet(folder).where(F.col("p") == ont("reported"))
    rows = runner.with_end(again.select("elem_ts", F.col("s").alias("place"), "o_num"), ends, "elem_ts")
    seen = runner.stream_window(rows, "elem_ts", hours(6, 1, ticks), ticks, "PT1H")
    out = seen.groupBy("tick", "place").agg(F.count(F.lit(1)).alias("n"), F.max("o_num").alias("top"))
    return runner.drain(t.spark, out, "chained", ends, "elem_ts")


@query(
    "A16_choose_graphs",
    f"""SELECT 'urn:default' AS g, s, p, o FROM {PLACE_SQL} WHERE g IN ('<{DATA}graph/0>', '<{DATA}graph/1>')
 UNION ALL SELECT g, s, p, o FROM {PLACE_SQL} WHERE g = '<{DATA}graph/2>'""",
)
def _a16(t: Tables):
    graph = lambda n: f"<{DATA}graph/{n}>"
    return q.choose_graphs(place_quads(t), [graph(0), graph(1)], [graph(2)]).select(*q.KEY)


# Patterns ---------------------------------------------------------------------------------------


@query(
    "B1_scan",
    f"SELECT s AS customer, o AS nation FROM {CUSTOMER_SQL} WHERE p = '{ont('nation')}'",
)
def _b1(t: Tables):
    return p.match(customer_quads(t), Pattern("?customer", ont("nation"), "?nation"))


_PROBE = {"g": f"<{DATA}graph/3>", "s": f"<{DATA}nation/3>", "p": ont("region"), "o": f"<{DATA}region/3>"}


def _matrix_sql() -> str:
    parts = []
    for mask in range(16):
        cond = " AND ".join(f"{c} = '{_PROBE[c]}'" for i, c in enumerate("gspo") if mask >> i & 1) or "true"
        parts.append(f"SELECT {mask} AS mask, CAST(count(*) AS BIGINT) AS n FROM {PLACE_SQL} WHERE {cond}")
    return " UNION ALL ".join(parts)


@query("B1_scan_all_bound_positions", _matrix_sql())
def _b1_matrix(t: Tables):
    quads = place_quads(t)
    out = []
    for mask in range(16):
        at = {c: _PROBE[c] if mask >> i & 1 else f"?{c}" for i, c in enumerate("gspo")}
        found = p.match(quads, Pattern(at["s"], at["p"], at["o"], at["g"]))
        out.append(found.agg(F.lit(mask).alias("mask"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, out)


@query(
    "B2_contains",
    f"""SELECT count(*) > 0 AS found FROM {CUSTOMER_SQL}
 WHERE s = '<{DATA}customer/7>' AND p = '{vocab.RDF_TYPE}' AND o = '{ont('Customer')}' AND g = 'urn:default'""",
)
def _b2(t: Tables):
    return p.contains(customer_quads(t), f"<{DATA}customer/7>", vocab.RDF_TYPE, ont("Customer"), vocab.DEFAULT_GRAPH)


@query(
    "B3_repeated_variable",
    f"SELECT DISTINCT {node('entity', 'l_orderkey')} AS x FROM lineitem WHERE l_orderkey = l_partkey",
)
def _b3(t: Tables):
    quads = q.table_quads(
        t.lineitem, q.subject(DATA + "entity/%s", F.col("l_orderkey")),
        {ont("contains"): q.resource(DATA + "entity/%s", F.col("l_partkey"))},
    )
    return p.match(q.distinct_quads(quads.select(*q.KEY)), Pattern("?x", ont("contains"), "?x"))


@query(
    "B4_basic_pattern",
    f"""SELECT c.s AS c, c2.o AS cname, n2.o AS nname, r2.o AS rname FROM {CUSTOMER_SQL} c
 JOIN {CUSTOMER_SQL} c2 ON c2.s = c.s AND c2.p = '{ont('name')}'
 JOIN {PLACE_SQL} n ON n.s = c.o AND n.p = '{ont('region')}' JOIN {PLACE_SQL} n2 ON n2.s = n.s AND n2.p = '{ont('name')}'
 JOIN {PLACE_SQL} r2 ON r2.s = n.o AND r2.p = '{ont('name')}' WHERE c.p = '{ont('nation')}'""",
)
def _b4(t: Tables):
    quads = customer_quads(t).unionByName(place_quads(t))
    found = p.basic_pattern(quads, [
        Pattern("?c", ont("nation"), "?n"), Pattern("?r", ont("name"), "?rname"), Pattern("?c", ont("name"), "?cname"),
        Pattern("?n", ont("name"), "?nname"), Pattern("?n", ont("region"), "?r"),
    ])
    return found.select("c", "cname", "nname", "rname")


_ANNOTATED_SQL = f"""SELECT {node('graph', 'event_id')} AS g, {node('observation', 'event_id')} AS obs, value,
 '"N(0,' || json_extract_string(props, '$.k') || '.5)"^^<{vocab.DISTRIBUTION}>' AS unc FROM events"""


@query("B5_embedded_pattern_asserted", _ANNOTATED_SQL)
def _b5(t: Tables):
    outer = Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), vocab.UNCERTAINTY, "?unc", "?g")
    found = p.match(event_quads(t), outer, asserted=True)
    return found.withColumn("value", terms.num(F.col("v"))).drop("v")


@query("B5_embedded_pattern", _ANNOTATED_SQL)
def _b5_fast(t: Tables):
    outer = Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), vocab.UNCERTAINTY, "?unc", "?g")
    return p.match(event_quads(t), outer, asserted=False).withColumn("value", terms.num(F.col("v"))).drop("v")


@query("B5_embedded_pattern_after_delete", f"{_ANNOTATED_SQL} WHERE event_type <> 'click'")
def _b5_deleted(t: Tables):
    # The inner statements of clicks go, so what is said about them is no longer found.
    quads = event_quads(t).drop("elem_id", "ts")
    clicks = p.match(quads, Pattern("?s", vocab.RDF_TYPE, ont("click")))
    reported = quads.where((F.col("p") == vocab.HAS_RESULT) & F.col("s_t").isNull()).join(q.sorted_join(clicks), "s", "left_semi")
    outer = Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), vocab.UNCERTAINTY, "?unc", "?g")
    found = p.match(forms.delete_data(quads, reported), outer)
    return found.withColumn("value", terms.num(F.col("v"))).drop("v")


@query(
    "B6_open_bound_reference",
    f"SELECT {node('observation', 'event_id')} AS obs, '{vocab.HAS_RESULT}' AS pred, value FROM events WHERE event_type = 'click'",
)
def _b6(t: Tables):
    refs = p.match(event_quads(t), Pattern(Quoted(None, None, None, ref="?t"), vocab.UNCERTAINTY, None))
    parts = terms.decode_triple(F.col("t"))
    opened = refs.select(parts["s"].alias("obs"), parts["p"].alias("pred"), terms.num(parts["o"]).alias("value"))
    clicks = p.match(event_quads(t), Pattern("?obs", vocab.RDF_TYPE, ont("click")))
    return p.join_solutions(opened, clicks)


@query(
    "B7_bind_statement",
    f"""SELECT '<< ' || {node('customer', 'c_custkey')} || ' {ont('nation')} ' || {node('nation', 'c_nationkey')} || ' >>' AS t FROM customer""",
)
def _b7(t: Tables):
    found = p.match(customer_quads(t), Pattern("?c", ont("nation"), "?n"))
    return found.select(terms.triple(F.col("c"), F.lit(ont("nation")), F.col("n")).alias("t"))


@query(
    "B8_graph",
    f"""SELECT g, s, o AS name FROM {PLACE_SQL} WHERE p = '{ont('name')}' AND g <> 'urn:default'
 UNION ALL SELECT 'one' AS g, s, o FROM {PLACE_SQL} WHERE p = '{ont('name')}' AND g = '<{DATA}graph/1>'""",
)
def _b8(t: Tables):
    quads = place_quads(t)
    every = p.match(p.in_graph(quads, "?g"), Pattern("?s", ont("name"), "?name", "?g"))
    one = p.match(p.in_graph(quads, f"<{DATA}graph/1>"), Pattern("?s", ont("name"), "?name"))
    return every.unionByName(one.withColumn("g", F.lit("one")))


@query(
    "B9_property_lists",
    f"""SELECT c.s AS c, c.o AS name, r.o AS rname FROM {CUSTOMER_SQL} c
 JOIN {CUSTOMER_SQL} cn ON cn.s = c.s AND cn.p = '{ont('nation')}' JOIN {CUSTOMER_SQL} cs ON cs.s = c.s AND cs.p = '{ont('segment')}'
 JOIN {PLACE_SQL} n ON n.s = cn.o AND n.p = '{ont('region')}' JOIN {PLACE_SQL} r ON r.s = n.o AND r.p = '{ont('name')}'
 WHERE c.p = '{ont('name')}' AND cs.o = '"BUILDING"'""",
)
def _b9(t: Tables):
    quads = customer_quads(t).unionByName(place_quads(t))
    wanted = p.about("?c", {
        vocab.RDF_TYPE: ont("Customer"), ont("name"): "?name", ont("segment"): '"BUILDING"',
        ont("nation"): {ont("region"): {ont("name"): "?rname"}},
    })
    return p.basic_pattern(quads, wanted)


@query(
    "B9_collections",
    f"""SELECT {node('conversation', 'a.conv_id')} AS c, a.role AS first, b.role AS second
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1
 WHERE (SELECT max(turn) FROM conversations x WHERE x.conv_id = a.conv_id) = 1""",
)
def _b9_lists(t: Tables):
    # Every conversation as an rdf list of its turns; the pattern asks for lists of exactly two.
    turns = t.conversations.select("conv_id", "turn", "role")
    cell = lambda n: terms.bnode(F.concat_ws("_", "conv_id", n))
    heads = turns.where(F.col("turn") == 0).select(
        q.subject(DATA + "conversation/%s", F.col("conv_id")).alias("s"), F.lit(ont("turns")).alias("p"), cell(F.lit(0)).alias("o")
    )
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pairs = F.explode(F.array(
        F.struct(F.lit(vocab.RDF_FIRST).alias("p"), terms.string(F.col("role")).alias("o")),
        F.struct(
            F.lit(vocab.RDF_REST).alias("p"),
            F.when(F.col("turn") == F.col("last"), vocab.RDF_NIL).otherwise(cell(F.col("turn") + 1)).alias("o"),
        ),
    ))
    cells = turns.join(last, "conv_id").select(cell(F.col("turn")).alias("s"), pairs.alias("x")).select("s", "x.p", "x.o")
    quads = heads.unionByName(cells).withColumn("g", F.lit(vocab.DEFAULT_GRAPH))
    wanted = [Pattern("?c", ont("turns"), "?list"), *p.collection("?list", ["?first", "?second"])]
    found = p.basic_pattern(quads, wanted)
    return found.select("c", *[terms.lex(F.col(c)).alias(c) for c in ("first", "second")])


@query("B10_reified_pattern", _ANNOTATED_SQL)
def _b10(t: Tables):
    plain = p.reify(event_quads(t).drop("elem_id", "ts"))
    found = p.basic_pattern(plain, [
        Pattern("?x", vocab.RDF_TYPE, vocab.RDF_STATEMENT, "?g"), Pattern("?x", vocab.RDF_SUBJECT, "?obs", "?g"),
        Pattern("?x", vocab.RDF_PREDICATE, vocab.HAS_RESULT, "?g"), Pattern("?x", vocab.RDF_OBJECT, "?v", "?g"),
        Pattern("?x", vocab.UNCERTAINTY, "?unc", "?g"),
    ])
    return found.select("g", "obs", terms.num(F.col("v")).alias("value"), "unc")


@query("B10_reified_to_embedded", _ANNOTATED_SQL)
def _b10_back(t: Tables):
    back = p.unreify(p.reify(event_quads(t).drop("elem_id", "ts")))
    found = p.match(back, Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), vocab.UNCERTAINTY, "?unc", "?g"))
    return found.select("g", "obs", terms.num(F.col("v")).alias("value"), "unc")


_REGION = f"'<< ' || s || ' ' || p || ' ' || o || ' >>'"


@query(
    "B10_reified_round_trip",
    f"""SELECT g, s, p, o FROM {PLACE_SQL}
 UNION ALL SELECT g, {_REGION}, '{ont('statedBy')}', s FROM {PLACE_SQL} WHERE p = '{ont('region')}'
 UNION ALL SELECT g, s, '{ont('states')}', {_REGION} FROM {PLACE_SQL} WHERE p = '{ont('region')}'""",
)
def _b10_whole(t: Tables):
    quads = place_quads(t).select(*q.KEY)
    region = quads.where(F.col("p") == ont("region"))
    inner = terms.triple(F.col("s"), F.col("p"), F.col("o"))
    about = region.select("g", inner.alias("s"), F.lit(ont("statedBy")).alias("p"), F.col("s").alias("o"))
    states = region.select("g", "s", F.lit(ont("states")).alias("p"), inner.alias("o"))
    return p.unreify(p.reify(quads.unionByName(about).unionByName(states))).select(*q.KEY)
