"""The monitoring queries on a tiny stream with hand-worked rows, from relations and from text."""

import math

import pytest
from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import uncertainty as u
from quadtide.operators.windows import Ticks, TimeWindow, instant
from quadtide.plans import monitoring as m
from quadtide.operators.patterns import Pattern
from quadtide.plans import observations as o
from quadtide.sources import trig
from tests.conftest import rows

START = instant("2021-03-01T10:00:00")
LOW = [(0, 0, 0.17), (3, 1, 0.20), (4, 0, 0.175)]
HIGH = [(0, 0, 31.0), (2, 1, 29.0), (4, 0, 32.0)]
WANT = {
    (4, 0, 0.17, 31.0), (8, 0, 0.17, 31.0), (8, 0, 0.17, 32.0), (8, 0, 0.175, 31.0), (8, 0, 0.175, 32.0), (12, 0, 0.175, 32.0),
}
WINDOW = TimeWindow.of("PT10S", "PT1S", START)
TICKS = Ticks.at(START, "PT4S", 5)

HEAD = (
    f"@prefix rdf: <{vocab.RDF}> . @prefix sosa: <{vocab.SOSA}> . @prefix prov: <{vocab.PROV}> . @prefix xsd: <{vocab.XSD}> . "
    f"@prefix unc: <{vocab.UNC}> . @prefix : <http://example.org/ontology/> . @base <http://example.org/data/> .\n"
)


def table(spark, data, variance=None):
    df = spark.createDataFrame(data, "sec int, place int, value double")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(START) + F.col("sec") * 1_000_000)).drop("sec")
    return df if variance is None else df.withColumn("unc", u.normal(0.0, variance).struct())


def plain(df, *columns):
    sec = ((F.unix_micros("tick") - START) / 1_000_000).cast("int").alias("sec")
    return {tuple(r) for r in df.select(sec, *columns).collect()}


@pytest.mark.parametrize("hot_first", [False, True])
def test_low_while_hot(spark, hot_first):
    got = m.probably_low_while_hot(table(spark, LOW, 1e-4), table(spark, HIGH), "place", WINDOW, TICKS, 0.18, 0.6, 30.0, hot_first)
    assert plain(got, "place", "value1", "value2") == WANT
    bound = m.low_probability_while_hot(table(spark, LOW, 1e-4), table(spark, HIGH), "place", WINDOW, TICKS, 0.18, 0.2, 30.0, hot_first)
    chances = {round(r.p, 4) for r in bound.collect()}
    assert chances == {0.8413, 0.6915}


def element(stream, kind, n, sec, place, value, unc=None):
    """One reading on one line: when it was said, then what was said."""
    said, reading = f"<said/{stream}/{n}>", f"<reading/{stream}-{n}>"
    facts = [
        f"{reading} sosa:hasFeatureOfInterest <location/{place}>", f"{reading} sosa:hasSimpleResult {value}",
        f"{reading} sosa:madeBySensor <device/{place}/{kind}>", f"{reading} a sosa:Observation",
    ]
    if unc:
        facts.insert(0, f'<< {reading} sosa:hasSimpleResult {value} >> unc:uncertainty "{unc}"^^unc:distribution')
    when = f'{said} prov:generatedAtTime "2021-03-01T10:00:{sec:02d}"^^xsd:dateTime .'
    return f"{when} GRAPH {said} {{ {' . '.join(facts)} . }}\n"


STATIC = HEAD + """
:OxygenSensor1 a sosa:Sensor ; unc:uncertainty "U(-0.02,0.02)"^^unc:distribution .
:TemperatureSensor1 a sosa:Sensor ; unc:uncertainty "U(-3,3)"^^unc:distribution .
""" + "".join(
    f"<device/{i}/{kind}> a sosa:Sensor, :{cls} ;\n  :location <location/{i}> .\n"
    for i in (0, 1) for kind, cls in (("OS1", "OxygenSensor1"), ("OS2", "OxygenSensor2"), ("TS1", "TemperatureSensor1"), ("TS2", "TemperatureSensor2"))
)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("streams")
    data = {
        "low1": ("OS1", [(0, 0, 0.171), (2, 1, 0.19), (5, 0, 0.2)], None), "low2": ("OS2", LOW, "N(0,0.0001)"),
        "high1": ("TS1", [(1, 0, 30.5), (3, 1, 33.0), (6, 0, 28.0)], None), "high2": ("TS2", HIGH, "N(0,1)"),
    }
    for name, (kind, readings, unc) in data.items():
        body = "".join(element(name, kind, n, *r, unc) for n, r in enumerate(readings))
        (folder / f"{name}.trigs").write_text(HEAD + body)
    (folder / "static.ttl").write_text(STATIC)
    return folder, data


def streams(spark, files):
    folder, data = files
    return {n: trig.read_elements(spark, str(folder / f"{n}.trigs")) for n in data}, trig.read_dataset(spark, str(folder / "static.ttl"))


def test_low_while_hot_from_statements(spark, files):
    parts, _ = streams(spark, files)
    low = o.observations(parts["low2"], "place", vocab.FEATURE, WINDOW, TICKS, annotated=True)
    high = o.observations(parts["high2"], "place", vocab.FEATURE, WINDOW, TICKS, annotated=False)
    got = m.probably_low_while_hot(low, high, "place", WINDOW, TICKS, 0.18, 0.6, 30.0)
    want = {(t, f"<http://example.org/data/location/{p}>", a, b) for t, p, a, b in WANT}
    assert plain(got, "place", "value1", "value2") == want


def _cdf(kind, a, b, k):
    return 0.5 * math.erfc(-(k - a) / math.sqrt(2 * b)) if kind == "N" else min(max((k - a) / (b - a), 0.0), 1.0)


def _visible(sec, tick, width):
    return tick - width <= sec < tick


@pytest.mark.parametrize("reverse", [False, True])
def test_four_streams_from_statements(spark, files, reverse):
    parts, static = streams(spark, files)
    data = files[1]
    window, ticks = TimeWindow.of("PT5S", "PT1S", START), Ticks.at(START, "PT2S", 8)
    located = o.located_streams(parts, static, window, ticks)
    args = (located, o.located_errors(static), "location", window, ticks, 0.18, 0.21, 30.0, 27.0)
    got = plain(m.four_streams(*args, 0.3, reverse), *[f"value{i}" for i in range(1, 5)])
    want = set()
    for tick in range(0, 16, 2):
        seen = {n: [(p, v) for s, p, v in rs if _visible(s, tick, 5)] for n, (_, rs, _) in data.items()}
        for p1, a in seen["low1"]:
            for p2, b in seen["low2"]:
                for p3, c in seen["high1"]:
                    for p4, d in seen["high2"]:
                        chances = (
                            _cdf("U", a - 0.02, a + 0.02, 0.18), _cdf("N", b, 1e-4, 0.18),
                            1 - _cdf("U", c - 3, c + 3, 30), 1 - _cdf("N", d, 1, 30),
                        )
                        if p1 == p2 == p3 == p4 and min(chances) >= 0.3 and a < 0.21 and b < 0.21 and c > 27 and d > 27:
                            want.add((tick, a, b, c, d))
    assert got == want and want
    bound = m.four_streams(*args, None, reverse)
    assert {"p1", "p2", "p3", "p4"} <= set(bound.columns) and bound.count() >= len(want)


@pytest.mark.parametrize("reverse", [False, True])
def test_readings_differ_from_statements(spark, files, reverse):
    parts, static = streams(spark, files)
    window, ticks = TimeWindow.of("PT5S", "PT1S", START), Ticks.at(START, "PT2S", 8)
    located = o.located_streams({n: parts[n] for n in ("low1", "low2", "high1")}, static, window, ticks)
    errors = o.class_errors(static, o.LOW_1, "mu1").first().mu1
    mu1 = u.uniform(errors.a, errors.b).struct()
    out = m.readings_differ(*located, mu1, "location", window, ticks, 29.0, None, reverse)
    assert out.count() > 0
    for r in out.collect():
        assert r.p1 + r.p2 == pytest.approx(1.0)
    kept = m.readings_differ(*located, mu1, "location", window, ticks, 29.0, 0.6, reverse)
    assert rows(kept, "value1", "value2") == rows(out.where("p1 >= 0.6 or p2 >= 0.6"), "value1", "value2")


def test_equal_statements_count_once_and_different_ones_each(spark):
    """A position left open: statements that differ there are different solutions, repeated ones are not."""
    lines = [("e1", 0, "<a>"), ("e2", 1, "<a>"), ("e3", 1, "<b>")]
    df = spark.createDataFrame([(e, t, "<g>", "<s>", "<p>", x) for e, t, x in lines], "elem_id string, sec int, g string, s string, p string, o string")
    stream = df.withColumn("elem_ts", F.timestamp_micros(F.lit(START) + F.col("sec") * 1_000_000))
    window, ticks = TimeWindow.of("PT5S", "PT1S", START), Ticks.at(START, "PT1S", 4)
    from quadtide.operators.windows import unfold

    for pattern, n in ((Pattern("?s", "<p>", None, "?g"), 2), (Pattern("?s", "<p>", "?o", "?g"), 2), (Pattern("?s", "<p>", "<a>"), 1)):
        got = unfold(o.window_pattern(stream, [pattern], window, ticks), ticks)
        assert got.where(F.unix_micros("tick") == START + 2_000_000).count() == n


def test_statements_in_different_elements_meet_in_the_window(spark):
    """The value and its place come in two elements; only ticks that see both give a row."""
    lines = [
        ("e1", 0, "<g>", "<o>", vocab.HAS_RESULT, f'"5"^^<{vocab.XSD}integer>'), ("e2", 3, "<g>", "<o>", vocab.FEATURE, "<p>"),
        ("e3", 3, "<other>", "<o>", vocab.FEATURE, "<q>"), ("e4", 4, "<g>", "<o>", vocab.FEATURE, "<p>"),
    ]
    df = spark.createDataFrame(lines, "elem_id string, sec int, g string, s string, p string, o string")
    stream = df.withColumn("elem_ts", F.timestamp_micros(F.lit(START) + F.col("sec") * 1_000_000))
    window, ticks = TimeWindow.of("PT5S", "PT1S", START), Ticks.at(START, "PT1S", 12)
    found = o.observations(stream, "place", vocab.FEATURE, window, ticks, annotated=False)
    from quadtide.operators.windows import unfold

    assert sorted(plain(unfold(found, ticks), "place", "value")) == [(4, "<p>", 5.0), (5, "<p>", 5.0)]


def test_links_are_made_distinct_before_they_are_multiplied(spark):
    """Three links of each order line went through the exchange of the distinct."""
    from quadtide.plans import catalog

    catalog.load_all()
    plan = catalog.QUERIES["Q7_linked_events_threshold_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in plan and not [line for line in plan.splitlines() if "Aggregate" in line and "prop" in line]
