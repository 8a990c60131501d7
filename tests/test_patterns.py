from itertools import product

from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import terms
from quadtide.operators import forms
from quadtide.operators import patterns as p
from quadtide.operators import quads as q
from quadtide.operators.patterns import Pattern, Quoted
from quadtide.plans.catalog.views import event_quads
from quadtide.sources.tables import Tables
from tests.conftest import rows

X, Y = "<http://x>", "<http://y>"


def test_find_with_every_subset_of_positions(spark):
    """Quads over two terms; a pattern with any positions bound gives exactly the matching ones."""
    data = [t for t in product((X, Y), repeat=4) if t != (X, X, Y, Y)]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    for mask in range(16):
        probe = [X if mask >> i & 1 else f"?{c}" for i, c in enumerate("gspo")]
        got = p.match(quads, Pattern(probe[1], probe[2], probe[3], probe[0]))
        want = [d for d in data if all(mask >> i & 1 == 0 or d[i] == X for i in range(4))]
        assert got.count() == len(want)
    assert p.contains(quads, X, X, X, X).first().found
    assert not p.contains(quads, X, Y, Y, X).first().found


def test_nested_statement_asserts_two_more(spark):
    inner = f"<< {X} {Y} {X} >>"
    middle = f"<< {inner} {Y} {Y} >>"
    quads = spark.createDataFrame([("<http://g>", middle, Y, X)], "g string, s string, p string, o string")
    got = q.assert_embedded(quads)
    assert rows(got, "g", "s", "o") == sorted([("<http://g>", X, X), ("<http://g>", inner, Y), ("<http://g>", middle, X)])
    assert q.assert_embedded(got).count() == 3


def test_repeated_variable(spark):
    quads = spark.createDataFrame([("g", X, Y, X), ("g", X, Y, Y)], "g string, s string, p string, o string")
    assert rows(p.match(quads, Pattern("?a", "?b", "?a"))) == [(X, Y)]


def test_embedded_pattern_same_graph(spark):
    e = f"<< {X} {Y} {X} >>"
    data = [("g1", e, Y, '"m"'), ("g1", X, Y, X), ("g2", e, Y, '"n"')]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    pattern = Pattern(Quoted("?a", "?b", "?c", ref="?t"), "?d", "?m", "?g")
    assert p.match(quads, pattern, asserted=False).count() == 2
    assert rows(p.match(quads, pattern), "g", "t") == [("g1", e)]
    both = Pattern(Quoted(Quoted("?a", None, None), None, None), None, "?m")
    assert p.match(quads, both).count() == 0


def test_reified_and_back(spark):
    e = f"<< {X} {Y} {X} >>"
    quads = spark.createDataFrame([("g", e, Y, '"m"'), ("g", e, X, '"n"'), ("g", X, Y, X)], "g string, s string, p string, o string")
    plain = p.reify(quads)
    assert plain.count() == 3 + 4
    assert rows(p.unreify(plain), "s", "p", "o") == rows(quads, "s", "p", "o")


def test_reified_objects_and_other_statements_come_back(spark):
    e = f"<< {X} {Y} {X} >>"
    data = [("g", X, Y, e), ("g", e, Y, e), ("g", X, Y, X), ("g", Y, vocab.RDF_TYPE, X), ("h", X, Y, e), ("g", "_:n", vocab.RDF_SUBJECT, X)]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    plain = p.reify(quads)
    assert plain.count() == 6 + 2 * 4
    assert plain.where(terms.is_triple(F.col("s")) | terms.is_triple(F.col("o"))).count() == 0
    back = p.unreify(plain)
    assert rows(back, "g", "s", "p", "o") == sorted(data)
    assert back.where("o_t is not null").count() == 3


def test_graph_variable_sees_named_graphs_only(spark):
    quads = spark.createDataFrame([(vocab.DEFAULT_GRAPH, X, Y, X), ("g", X, Y, Y)], "g string, s string, p string, o string")
    assert rows(p.in_graph(quads, "?g"), "g") == [("g",)]


def test_element_times_default_to_the_epoch(spark):
    data = [("e1", vocab.DEFAULT_GRAPH, X, vocab.GENERATED_AT, '"2021-03-01T10:00:00Z"^^<%sdateTime>' % vocab.XSD), ("e2", "g", X, Y, X)]
    quads = q.with_typed(spark.createDataFrame(data, "elem_id string, g string, s string, p string, o string"))
    got = {r.elem_id: str(r.elem_ts) for r in q.element_times(quads).collect()}
    assert got == {"e1": "2021-03-01 10:00:00", "e2": "1970-01-01 00:00:00"}


def test_written_layout_reads_back(spark, tmp_path):
    quads = spark.createDataFrame([("g", X, Y, X), ("g", Y, X, X)], "g string, s string, p string, o string")
    q.write_quads(quads, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where(F.col("p") == Y).count() == 1


def test_constant_quads(spark):
    got = q.constant_quads(spark, [("g", X, Y, terms_int := f'"5"^^<{vocab.XSD}integer>')])
    assert got.first().o_num == 5.0 and terms_int in got.first().o
    assert got.where(terms.is_numeric(F.col("o"))).count() == 1


def _broadcasts(df):
    # Of the initial plan, as estimates by file size make it.
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_joins_on_terms_copy_no_side_to_every_task(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    outer = Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), vocab.UNCERTAINTY, "?unc", "?g")
    quads = event_quads(t).drop("elem_id", "ts")
    assert _broadcasts(p.match(quads, outer)) == 0
    assert _broadcasts(p.basic_pattern(quads, [outer, Pattern("?obs", vocab.RDF_TYPE, "?type", "?g")])) == 0
    assert _broadcasts(p.unreify(p.reify(quads))) == 0
    assert _broadcasts(forms.delete_data(quads, quads.where(F.col("p") == vocab.HAS_RESULT))) == 0


def test_embedded_pattern_with_constants(spark):
    e = f"<< {X} {Y} {X} >>"
    data = [("g1", e, Y, '"m"'), ("g1", X, Y, X), ("g2", e, Y, '"n"'), ("g2", X, Y, Y)]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    assert rows(p.match(quads, Pattern(Quoted(X, Y, "?c"), "?d", "?m", "?g")), "g", "c") == [("g1", X)]
    assert p.match(quads, Pattern(Quoted(X, Y, X), None, "?m", "g1")).count() == 1
    assert p.match(quads, Pattern(Quoted(X, Y, X), None, "?m", "g2")).count() == 0


def test_all_readings_of_reified_nodes_are_one(spark):
    """Nodes are read as rows, and as descriptions of subjects and objects: a check in some of them only would make them differ."""
    quads = q.constant_quads(spark, [("urn:g", "<< <a> <p> <b> >>", "<q>", "<< <c> <p> <d> >>"), ("urn:g", "<a>", "<p>", "<b>")])
    back = p.unreify(p.reify(quads))
    assert "isnotnull(concat(_:" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in back.select("s", "o").collect()} == {("<< <a> <p> <b> >>", "<< <c> <p> <d> >>"), ("<a>", "<b>")}
