import random

import pytest
from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import terms
from quadtide.operators import quads as q
from quadtide.sources import records
from quadtide.sources.records import Cutter
from quadtide.sources import sinks, trig
from tests.conftest import rows

HEAD = "@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @base <http://b/> .\n"


def read(text, **kw):
    return trig.RecordReader(text, "f", {"": "http://x/", "xsd": vocab.XSD}, "http://b/").read()


def test_lists_of_properties_and_literals():
    got = read('<a> a :T ; :p 1 , 2.5 , 1e3 , true ; :q "x"@EN , "y"^^xsd:date , "z"^^xsd:string , "tab\\t\\"q\\"" .')
    objects = [r[3] for r in got]
    x = "^^<" + vocab.XSD
    assert objects == [
        "<http://x/T>", f'"1"{x}integer>', f'"2.5"{x}decimal>', f'"1e3"{x}double>', f'"true"{x}boolean>',
        '"x"@en', f'"y"{x}date>', '"z"', '"tab\\t\\"q\\""',
    ]
    assert {r[1] for r in got} == {"<http://b/a>"} and got[0][2] == vocab.RDF_TYPE


def test_embedded_statements_are_asserted_at_every_depth():
    got = read("GRAPH <g> { << << <a> :p <b> >> :q <c> >> :r << <d> :s <e> >> . }")
    assert len(got) == 4
    assert {r[0] for r in got} == {"<http://b/g>"}
    outer = got[-1]
    assert outer[1] == "<< << <http://b/a> <http://x/p> <http://b/b> >> <http://x/q> <http://b/c> >>"
    assert outer[4][0] == "<< <http://b/a> <http://x/p> <http://b/b> >>"
    assert outer[5] == ("<http://b/d>", "<http://x/s>", "<http://b/e>")


def test_blank_nodes_and_collections():
    got = read("<a> :p [ :q 1 ; :r [ :s 2 ] ] , ( 1 2 ) , () . _:n :t _:n .")
    by = {}
    for _, s, p, o, *_ in got:
        by.setdefault(p, []).append((s, o))
    assert by["<http://x/t>"] == [("_:fn", "_:fn")]
    assert len(by[vocab.RDF_FIRST]) == 2 and by[vocab.RDF_REST][-1][1] == vocab.RDF_NIL
    assert [o for _, o in by["<http://x/p>"]][-1] == vocab.RDF_NIL


@pytest.mark.parametrize("bad", ["<a> :p", "<a> nope:p <b> .", "<a> :p \"open .", "<< <a> :p <b> :q <c> ."])
def test_broken_text_is_an_error(bad):
    with pytest.raises((ValueError, IndexError)):
        read(bad)


def test_elements_have_their_time(spark, tmp_path):
    line = 'GRAPH <g{0}> {{ <o{0}> :v {0}.5 . << <o{0}> :v {0}.5 >> :u "N(0,1)" . }} <t{0}> <%sgeneratedAtTime> "2021-03-01T10:00:0{0}"^^xsd:dateTime .' % vocab.PROV
    (tmp_path / "s.trigs").write_text(HEAD + "\n".join(line.format(i) for i in range(4)) + "\n<x> :late 1 .\n")
    got = trig.read_elements(spark, str(tmp_path))
    times = {r.elem_id: r.elem_ts for r in got.collect()}
    assert len(times) == 5
    assert sorted(str(t) for t in times.values())[0] == "1970-01-01 00:00:00"
    assert got.where("p = '<http://x/v>'").agg(F.sum("o_num")).first()[0] == 8.0  # 0.5 + 1.5 + 2.5 + 3.5
    assert got.where("s_t is not null").count() == 4


def test_files_with_different_prefixes(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix p: <http://one/> .\np:s p:q p:o .\n")
    (tmp_path / "b.ttl").write_text("@prefix p: <http://two/> .\np:s p:q p:o .\n")
    got = trig.read_dataset(spark, str(tmp_path))
    assert rows(got, "s") == [("<http://one/s>",), ("<http://two/s>",)]


def test_blank_nodes_of_different_records(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(HEAD + '<1> :p [ :q "one" ] .\n<2> :p [ :q "two" ] .\n<3> :p ( 1 ) .\n<4> :r _:b1 .\n_:b1 :q "four" .\n')
    for unit in ("statement", "line", "file"):
        got = trig.read_dataset(spark, str(tmp_path), None if unit != "file" else {}, unit=unit)
        ends = got.where("p = '<http://x/q>'").select(F.col("s").alias("o"), F.col("o").alias("v"))
        found = got.where("p in ('<http://x/p>', '<http://x/r>')").join(ends, "o")
        assert rows(found, "s", "v") == [("<http://b/1>", '"one"'), ("<http://b/2>", '"two"'), ("<http://b/4>", '"four"')]
        assert got.where(terms.is_blank(F.col("s"))).select("s").distinct().count() == 4


def test_equal_elements_stay_distinct_and_labels_are_theirs(spark, tmp_path):
    (tmp_path / "a.trigs").write_text(HEAD + "<1> :p [ :q _:x ] .\n" * 2)
    got = trig.read_elements(spark, str(tmp_path))
    for c in ("elem_id", "s", "o"):
        assert got.where("p = '<http://x/q>'").select(c).distinct().count() == 2


def test_labels_of_a_written_dataset(spark, tmp_path):
    data = [("urn:default", "_:n", "<http://p>", f'"{i}"') for i in range(4)]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string").repartition(4)
    sinks.write_statements(quads, str(tmp_path / "out"))
    nodes = lambda **kw: trig.read_dataset(spark, str(tmp_path / "out"), {}, unit="line", **kw).select("s").distinct().count()
    assert nodes(labels="dataset") == 1 and nodes() > 1


def test_redeclared_and_contradicting_prefixes(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix a: <http://one/> .\na:1 a:p a:o .\n@prefix a: <http://two/> .\na:2 a:p a:o .\n")
    (tmp_path / "b.ttl").write_text("a:3 a:p a:o .\n")
    (tmp_path / "c.ttl").write_text("@prefix a: <http://three/> .\na:4 a:p a:o .\n")
    want = [("<http://one/1>",), ("<http://one/3>",), ("<http://three/4>",), ("<http://two/2>",)]
    for unit in ("statement", "line"):
        assert rows(trig.read_dataset(spark, str(tmp_path), unit=unit), "s") == want


def test_units_agree(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(HEAD + '# a comment first\n<a> a :T ;\n  :p "x.y" ,\n  2 .\n\n<b> :p [ :q 1 ] .\n<c> :p 3 .')
    one = trig.read_dataset(spark, str(tmp_path), unit="statement")
    two = trig.read_dataset(spark, str(tmp_path), unit="file")
    # There is one blank node, so its name may be left out of the comparison.
    blank = lambda c: F.when(terms.is_blank(F.col(c)), "_:").otherwise(F.col(c)).alias(c)
    plain = lambda d: rows(d.select("g", blank("s"), "p", blank("o")), "g", "s", "p", "o")
    for d in (one, two):
        assert d.where(terms.is_blank(F.col("s"))).first().s == d.where(terms.is_blank(F.col("o"))).first().o
    assert plain(one) == plain(two) and one.count() == two.count() == 6


def test_written_statements_read_back(spark, tmp_path):
    data = [("urn:default", "<http://s>", "<http://p>", '"line\\nbreak \\"q\\" \\\\ end"'), ("<http://g>", "_:b", "<http://p>", '"x"@en')]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    sinks.write_statements(quads, str(tmp_path / "out"))
    back = trig.read_dataset(spark, str(tmp_path / "out"), prefixes={}, unit="line")
    assert rows(back, "p", "o") == sorted((d[2], d[3]) for d in data)
    assert back.where("g = '<http://g>'").first().s.startswith("_:f")


def test_terms_round_trip(spark):
    texts = ['plain', 'quote " and \\ back', 'line\nbreak\ttab\r', '\\n not a break', '', 'ends with "', 'é' * 5000 + '\n' * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for made in (terms.string(F.col("x")), terms.tagged(F.col("x"), F.lit("EN")), terms.typed(F.col("x"), "http://t")):
        assert df.where(terms.lex(made) != F.col("x")).count() == 0
    assert df.select(terms.lang(terms.tagged(F.col("x"), F.lit("EN"))).alias("l")).distinct().first().l == "en"
    assert df.select(terms.datatype(terms.typed(F.col("x"), "http://t")).alias("l")).distinct().first().l == "http://t"


def test_decode_embedded(spark):
    s, p, o = "<http://a>", "<http://p>", '"x >> <http://y> z"@en'
    one = f"<< {s} {p} {o} >>"
    two = f"<< {one} {p} {one} >>"
    three = f"<< {two} {p} {two} >>"
    df = spark.createDataFrame([(one,), (two,), (three,), (s,)], "t string")
    got = [r.d for r in df.select(terms.decode_triple(F.col("t")).alias("d")).collect()]
    assert [None if d is None else tuple(d) for d in got] == [(s, p, o), (one, p, one), (two, p, two), None]
    for _ in range(6):
        deep = f"<< {three} {p} {o} >>"
        d = spark.createDataFrame([(deep,)], "t string").select(terms.decode_triple(F.col("t")).alias("d")).first().d
        assert tuple(d) == (three, p, o)
        three = deep


def test_embedded_at_any_depth(spark):
    p, o = "<http://p>", '"<< not >> one \\" >>"'
    term, inner = "<http://a>", []
    for n in range(7):
        term = f"<< {term} {p} {o if n % 2 else term} >>"
        inner.append(term)
    df = spark.createDataFrame([(term,), ("<http://a>",), (o,), (f"<< <http://a> {p} {o} >>",)], "t string")
    got = [r.e for r in df.select(terms.embedded(F.col("t")).alias("e")).collect()]
    assert set(got[0]) == set(inner) and got[1:] == [None, None, [f"<< <http://a> {p} {o} >>"]]


def test_deep_terms_are_unfolded_in_one_reading(spark):
    """Each level was read again to find its parts, in work that grew with the square of the depth."""
    term, levels = "<http://a>", 150
    for n in range(levels):
        term = f'<< {term} <http://p{n}> "{n} >>" >>' if n % 3 else f"<< {term} <http://p{n}> <http://o> >>"
    got = q.assert_embedded(spark.createDataFrame([("<http://g>", term, "<http://p>", "<http://o>")], "g string, s string, p string, o string")).select("g", "s", "p", "o")
    assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.p: r for r in got.collect()}
    assert len(found) == levels + 1 and found["<http://p>"].s == term
    assert found["<http://p149>"].s == term[3:term.rindex(" <http://p149>")] and found["<http://p149>"].o == '"149 >>"'
    assert found["<http://p0>"].s == "<http://a>" and found["<http://p0>"].o == "<http://o>"


def test_rows_are_exchanged_before_they_are_unfolded(spark):
    """Every statement of a row was exchanged with all that it embeds, and rows for the reader of terms piled up on
    disk behind the aggregation of statements."""
    def term(n, levels):
        return f"<< {term(n, levels - 1)} <http://p{levels}> <http://o{n % 3}> >>" if levels else f"<http://a{n}>"

    made = [("<http://g>", term(n, 6), "<http://p>", "<http://o>") for n in range(50)] * 2
    got = q.assert_embedded(spark.createDataFrame(made, "g string, s string, p string, o string")).select("g", "s", "p", "o")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1 and plan.index("posexplode(slice") < plan.index("Exchange")
    inner = [("<http://g>", term(n, k), f"<http://p{k + 1}>", f"<http://o{n % 3}>") for n in range(50) for k in range(6)]
    assert rows(got) == sorted({*made, *inner})


def test_every_statement_is_asserted_once(spark):
    """Against statements made as trees: chains that share their beginnings, embedded objects, repeated rows and nulls."""
    pick = random.Random(3).choice
    leaves = ["<http://a>", "_:b", '"x >> << y"', '"q"@en', '"1.5"^^<%sdouble>' % vocab.XSD]

    def tree(depth):
        return (tree(depth - 1), pick(["<http://p>", "<http://q>"]), tree(pick([0, 0, depth - 1]))) if depth and pick("aab") == "a" else pick(leaves)

    def text(x):
        return x if x is None or isinstance(x, str) else "<< " + " ".join(map(text, x)) + " >>"

    def parts(x):
        return {tuple(map(text, x))} | parts(x[0]) | parts(x[2]) if isinstance(x, tuple) else set()

    made, want = [], set()
    for _ in range(600):
        k, g, s, p, o = pick(["k", "l", None]), pick(["g", None]), pick([tree(4), None]), pick(["<http://p>", None]), pick([tree(4), None])
        made.append((k, g, text(s), p, text(o)))
        want |= {(k, g, text(s), p, text(o))} | {(k, g, *x) for x in parts(s) | parts(o)}
    df = spark.createDataFrame(made + made[:99], "k string, g string, s string, p string, o string").repartition(5)
    got = q.assert_embedded(df, keep=["k"])
    order = lambda found: sorted(found, key=str)
    assert order(tuple(r) for r in got.select("k", "g", "s", "p", "o").collect()) == order(want)
    other = q.with_typed(got.drop("o_num", "o_ts", "s_t", "o_t")).select(got.columns)
    assert order(map(tuple, got.collect())) == order(map(tuple, other.collect()))


def test_views_of_rows_are_kept(spark):
    """A row that stands in another one as well keeps the views it came with."""
    data = [("g", "<< <a> <p> <b> >>", "<q>", "<c>", 7.0), ("g", "<a>", "<p>", "<b>", 5.0), ("g", "<< <a> <p> <b> >>", "<q>", "<c>", 7.0)]
    got = q.assert_embedded(spark.createDataFrame(data, "g string, s string, p string, o string, o_num double"))
    assert rows(got, "s", "o_num") == [("<< <a> <p> <b> >>", 7.0), ("<a>", 5.0)]


def test_terms_written_otherwise(spark):
    """Texts that are no canonical terms stay as they are, and the statements closed in them are asserted."""
    data = {
        "<< <a> <b> >>": [("<a>", "<b>", "")], "<< <a> <p> <b> >> <x>": [("<a>", "<p>", "<b>")], "<< <a> <p> <b>": [],
        '<< <a> <p>  "b c" >>': [("<a>", "<p>", '"b c"')], "<< <a> <p> <b> <c> >>": [("<a>", "<p>", "<b> <c>")],
        "<< << <a> <p> <b> >> <q>": [("<a>", "<p>", "<b>")], "<< <a> <p> << <c> <p> <d> >> >> >>": [("<a>", "<p>", "<< <c> <p> <d> >>"), ("<c>", "<p>", "<d>")],
    }
    for s, want in data.items():
        got = q.assert_embedded(spark.createDataFrame([("g", s, "<q>", s)], "g string, s string, p string, o string"))
        assert rows(got, "s", "p", "o") == rows(spark.createDataFrame([*want, (s, "<q>", s)], "s string, p string, o string"))


def test_embedded_statements_of_a_stream(spark, tmp_path):
    schema, path = "g string, s string, p string, o string", str(tmp_path / "in")
    data = spark.createDataFrame([("g", f"<< << <a> <p> <b> >> <q> <c> >>", "<r>", f"<o{n % 2}>") for n in range(4)], schema)
    data.write.parquet(path)
    found = q.assert_embedded(spark.readStream.schema(schema).parquet(path)).select("g", "s", "p", "o")
    write = found.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    write.format("parquet").start(str(tmp_path / "out")).awaitTermination()
    back = rows(spark.read.schema(schema).parquet(str(tmp_path / "out")))
    assert len(back) == 4 and back == rows(q.assert_embedded(data).select("g", "s", "p", "o"))


@pytest.mark.parametrize("lexical", ["1.5", '2"^^<http://www.w3.org/2001/XMLSchema#double>', "", "x"])
def test_numbers_are_read_without_patterns(spark, lexical):
    df = spark.range(1).select(F.lit(lexical).alias("x"))
    made = df.select(terms.typed(F.col("x"), vocab.XSD + "double").alias("t"), terms.string(F.col("x")).alias("s"), terms.tagged(F.col("x"), F.lit("en")).alias("l"))
    got = made.select(*[terms.num(F.col(c)).alias(c) for c in "tsl"])
    assert tuple(got.first()) == (1.5 if lexical == "1.5" else None, None, None)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("o", ["<http://o>", '"1.5"^^<http://t>', '"a b"', '""', f'"x"^^<{vocab.XSD}string>', '"x"@EN', '"q\\""', "_:b", "<o>", "2"])
@pytest.mark.parametrize("s", ["<http://s>", "<http://\u00e9/s>", "<s>", '<< <http://s> <http://p> "v"^^<http://t> >>', f'<< <http://s> <http://p> "v"^^<{vocab.XSD}string> >>'])
@pytest.mark.parametrize("around", ["%s .", "GRAPH <http://g> { %s . }", "GRAPH <http://g> { %s .", "%s . }", "%s"])
def test_single_statements_are_read_at_once(s, o, around):
    """Lines that were written as statements took the way of all text, sign by sign."""
    text = around % f"{s} <http://p> {o}"
    at_once = trig.plain_statement(text)
    whole = s.startswith(("<http", "<< ")) and "string" not in s + o and o not in ('"x"@EN', '"q\\""', "_:b", "<o>", "2")
    assert (at_once is not None) == (whole and around in ("%s .", "GRAPH <http://g> { %s . }"))
    if at_once is not None:
        assert at_once == read(text)


def test_tokens_are_found_at_once():
    """A record was cut by one match for each token, with a try at each kind in turn for every sign of a literal."""
    assert trig.RecordReader._scan(':a <b>"c d"^^x:y.5 . # e\n_:f , << a >> @en -1e3 \u0663') == [
        ("name", ":a"), ("iri", "<b>"), ("text", '"c d"'), ("type", "^^"), ("name", "x:y.5"), ("mark", "."), ("bnode", "_:f"), ("mark", ","),
        ("open", "<<"), ("word", "a"), ("close", ">>"), ("at", "@en"), ("num", "-1e3"), ("num", "\u0663"), ("end", ""),
    ]
    assert not trig._PIECE.groupindex
    for bad in ("\u00e9 .", "<a b>", '<a> "open', "^ ", "_ ", "<a> | <b>"):
        with pytest.raises(ValueError, match="unexpected text"):
            trig.RecordReader._scan(bad)


def test_wide_rows_sort_behind_the_exchange(spark):
    """Each task sorted all statements of its split, in memory that grew with the split."""
    quads = spark.createDataFrame([("g", "a", "p", "1"), ("g", "b", "p", "2"), ("g", "a", "q", "3"), ("g", "a", "r", "4")], "g string, s string, p string, o string")
    got = q.wide_rows(quads, {"x": ("p", "o"), "y": ("q", "o")})
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan and "Sort [" not in plan[plan.rindex("Exchange"):]
    assert rows(got, "s", "x", "y") == [("a", "1", "3"), ("b", "2", None)]


MANY = [
    "@prefix : <http://x/> .\n", ":a :p 1.5 ; :q \"dot. \" , 'x } y' .\n", "# a comment. with { signs } and \"quotes\n",
    "GRAPH :g {\n", "  :b :p \"\"\"long. \n\n } . \\\"\"\" still \" in. \n\"\"\" .\n", "  :c :p 2 .\n", "  :d :p <http://y/a.b> # no end.\n}\n",
    ":e :p '''one\ntwo. \"\"\" three\n''' . :f :p :g . :h :p 3.\n", "{ :i :p 4 }\n", "GRAPH\n\n:k\n{\n:l :p << :m :p 5 >> .\n\n", ":n :p 6 ;\n  :q 7\n}\n",
    ":o :p _:x . _:x :p 8 .\n", ":last :p 9",
]


@pytest.mark.parametrize("bytes_a_split", [7, 40, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_lines_and_splits(spark, tmp_path, bytes_a_split, end):
    """The same statements however the file is split, with line ends of either kind."""
    (tmp_path / "a.trig").write_bytes("".join(MANY * 3).replace("\n", end).encode())
    (tmp_path / "b.trig").write_bytes("".join(MANY).replace(":a ", ":other ").replace("\n", end).encode())
    (tmp_path / "c.trig").write_text("\n\n")
    want = set()
    for file in "ab":
        text = (tmp_path / f"{file}.trig").read_bytes().decode().split(":last")[0]
        want |= {r[:4] for r in trig.RecordReader(text, "", {}, "").read() if "_:" not in r[1] + r[3]}
    want.add(("urn:default", "<http://x/last>", "<http://x/p>", '"9"^^<http://www.w3.org/2001/XMLSchema#integer>'))
    keys = {"spark.sql.files.maxPartitionBytes": str(bytes_a_split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = trig.read_dataset(spark, str(tmp_path)).select("g", "s", "p", "o").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {tuple(r) for r in got if "_:" not in r.s + r.o} == want
    blank = [r for r in got if "_:" in r.s + r.o]
    assert len(blank) == 4 and len({r.s for r in blank if r.s[0] == "_"}) == 2


def test_a_cutter_starts_in_any_state():
    text = "".join(MANY)
    whole = Cutter(0, 0, None)
    records = [x for line in text.splitlines(True) for x in whole.feed(line)]
    for cut in range(1, len(text), 3):
        first = Cutter(0, 0, None)
        head = [x for line in text[:cut].splitlines(True) for x in first.feed(line)]
        if text[cut - 1] != "\n":
            continue
        second = Cutter(first.mode, first.depth, first.header)
        rest = [x for line in text[cut:].splitlines(True) for x in second.feed(line)]
        seen = lambda found: [(kind, graph is None) for kind, graph, _, _ in found]
        assert seen(head + rest) == seen(records)


def test_files_of_one_split_are_cut_once(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix : <http://o/> .\n:a :b """x .\n} y""" .\n:g { :a :b :c . :d :e :f }\n:last :b :c')
    (tmp_path / "b.ttl").write_text(":s :p :o .\n" * 3)
    found = records.cut(spark, str(tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in plan
    assert found.count() == 8
    # Only the file with a declaration is read for declarations.
    assert records.cut(spark, str(tmp_path), trig._DECLARING).select("file").distinct().count() == 1
    quads = trig.read_dataset(spark, str(tmp_path))
    assert quads.count() == 5 and quads.where("s = '<http://o/last>'").count() == 1


def test_starts_that_meet_come_to_one_state():
    text = "".join(f":g{n} {{\n:a :b {n} .\n}}\n" for n in range(50))
    cutters = [records.Cutter(s // 2, s % 2, None, known=False) for s in range(2)]
    for c in cutters:
        list(c.feed(text))
    assert cutters[0].state() == cutters[1].state()


SHAPED = [
    'GRAPH <g/{0}> {{ <o/{0}> a :T ; :p <x/{1}> ; :v "{1}.5"^^xsd:double . << <o/{2}> :v "{1}.5"^^xsd:double >> :u "N(0,{0})"^^:d . }} <g/{0}> :t "{2}" .',
    '<a/{0}> :p <b/{1}> , <a/{0}> ; <q/{2}> "x{1}"@EN , "y"^^<http://www.w3.org/2001/XMLSchema#string> , 7 , true .',
    '<{0}> :p "{1}"^^xsd:string . << << <a> :p <b{0}> >> :q <c> >> :r << <d> :s <e{1}> >> .',
    '<http://y/{0}> <../{1}> <#{2}> . <a> :p "" , "{0}" , "" .', "<a> :p 'x\"{0}' , <b> . # <c> \"d",
    '<a> :p """{0} "<b>" . """ , "q\\"{1}" .', '_:n :p [ :q <{0}> ] , ( <{1}> ) .', '@prefix n: <http://n/{0}/> . n:a n:b <{1}> .',
    'PREFIX x: <http://{0}/> <a> x:b "{1}" .', '<a>:p<b{0}>,"c""{1}" .', "<a> :p \"c\" ^^ <http://d/{0}> .", '<\\u0041{0}> :p "{1}\t" .',
    "{{ <a> :p <b{0}> }} GRAPH :g {{ <a> <p> <c{1}> . }}", "<a> :p <x-quadtide-slot:{0}> , \"x-quadtide-slot:{1}\" .", "<a> :p ;; .", "<a{0}> .", "<a> no:p <b> .",
]


@pytest.mark.parametrize("form", SHAPED)
@pytest.mark.parametrize("base", ["http://b/", "", "http://b/c?d"])
def test_records_read_by_their_shape_are_those_of_the_reader(form, base):
    prefixes = {"": "http://x/", "xsd": vocab.XSD}
    shapes = trig.Shapes(prefixes, base)
    for numbers in [(1, 2, 3), (4, 5, 6), (1, 1, 1), (0, 2, 0), (7, 8, 7)]:
        text = form.format(*numbers)
        got = shapes.read(text)
        try:
            want = trig.RecordReader(text, "f", prefixes, base).read()
        except (ValueError, KeyError):
            want = None
        assert got is None or got == want
    assert (got is not None) == (SHAPED.index(form) in (0, 1, 3, 12, 13, 15))


def test_elements_of_one_shape_are_scanned_twice_at_most(spark, monkeypatch, tmp_path):
    scan = trig.RecordReader._scan

    def some(text):
        if "<o/5>" in text or "<o/6>" in text:
            raise AssertionError("scanned")
        return scan(text)

    (tmp_path / "a.txt").write_text("".join(SHAPED[0].format(i, i % 3, i) + "\n" for i in range(7)))
    monkeypatch.setattr(trig.RecordReader, "_scan", staticmethod(some))
    got = trig.read_elements(spark, str(tmp_path), {"": "http://x/", "xsd": vocab.XSD}, "http://b/").collect()
    assert len(got) == 35 and {r["o"] for r in got if r["p"] == "<http://x/t>"} == {f'"{i}"' for i in range(7)}


def test_shapes_are_forgotten():
    shapes = trig.Shapes({"": "http://x/"}, "http://b/")
    for i in range(2 * trig.SHAPES):
        assert shapes.read(f"<a> :p {i} .") is None
    assert len(shapes.known) <= trig.SHAPES and shapes.read("<a> :p " + "<b> , " * trig.SHAPED + "<c> .") is None
