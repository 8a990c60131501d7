"""Observation tables out of statement streams, for the monitoring queries.

A stream table has the statement columns and ``elem_ts``. Every function returns spans: which ticks
see the row, because all of its statements are in the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import terms
from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let
from quadtide.operators import patterns as p
from quadtide.operators.patterns import Pattern, Quoted
from quadtide.operators.windows import HI, LO, Ticks, TimeWindow, distinct_spans, join_spans, spans
from quadtide.vocab import iri


def _open(pattern: Pattern | Quoted) -> bool:
    """Is there a position that neither a constant nor a variable names, so that statements may differ?"""
    parts = [pattern.s, pattern.p, pattern.o, *([pattern.g] if isinstance(pattern, Pattern) else [])]
    named = isinstance(pattern, Quoted) and pattern.ref
    return not named and any(x is None or isinstance(x, Quoted) and _open(x) for x in parts)


def window_pattern(
    stream: DataFrame, patterns: list[Pattern], window: TimeWindow, ticks: Ticks, distinct: bool = True
) -> DataFrame:
    """WINDOW { patterns }: solutions with the ticks at which all parts are in the window.

    Statements that several elements repeat count once per tick; ``distinct=False`` skips that
    where the source is known not to repeat any. Elements carry the statements they embed, as readers
    give them.
    """
    out = None
    longest = window.max_ticks(ticks)
    for pattern in patterns:
        # Spans come after the constants of the pattern have cut the stream down.
        whole = ["__g", "__s", "__p", "__o"] if distinct and _open(pattern) else []
        copies = stream.withColumns({c: F.col(c[2:]) for c in whole})
        found = p.match(copies, pattern, keep=["elem_ts", *whole], asserted=False)
        one = spans(found, "elem_ts", window, ticks).drop("elem_ts")
        if distinct:
            one = distinct_spans(one, [c for c in one.columns if c not in (LO, HI)]).drop(*whole)
        if out is None:
            out = one
        else:
            shared = [c for c in out.columns if c in one.columns and c not in (LO, HI)]
            out = join_spans(out, one, shared, longest)
    return out


def observations(
    stream: DataFrame, key: str, predicate: str, window: TimeWindow, ticks: Ticks, annotated: bool,
    annotation: str = vocab.UNCERTAINTY, distinct: bool = True,
) -> DataFrame:
    """Reported values of a stream: key, value, and the distribution stated about the report."""
    place = Pattern("?obs", predicate, f"?{key}", "?g")
    if annotated:
        value = Pattern(Quoted("?obs", vocab.HAS_RESULT, "?v"), annotation, "?u", "?g")
    else:
        value = Pattern("?obs", vocab.HAS_RESULT, "?v", "?g")
    found = window_pattern(stream, [value, place], window, ticks, distinct)
    columns = {"value": terms.num(F.col("v"))}
    if annotated:
        columns["unc"] = u.parse(terms.lex(F.col("u")))
    return let(found, **columns).select(key, *columns, LO, HI)


def sensors_of(static: DataFrame, kind: str, location: str) -> DataFrame:
    """Sensors of one class with their place."""
    found = p.basic_pattern(static, [Pattern("?sensor", vocab.RDF_TYPE, kind), Pattern("?sensor", location, "?location")])
    return found.select("sensor", "location")


def class_errors(static: DataFrame, kind: str, name: str, annotation: str = vocab.UNCERTAINTY) -> DataFrame:
    """The error distribution stated once for a whole class of sensors."""
    found = p.match(static, Pattern(kind, annotation, "?u"))
    return let(found, **{name: u.parse(terms.lex(F.col("u")))}).select(name)


def by_location(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Replace the sensor of a reading by its place."""
    return readings.join(sensors, "sensor").drop("sensor")


# The classes and the place property that the sensor descriptions use.
ONTOLOGY = "http://example.org/ontology/"
LOW_1, LOW_2 = iri(ONTOLOGY + "OxygenSensor1"), iri(ONTOLOGY + "OxygenSensor2")
HIGH_1, HIGH_2 = iri(ONTOLOGY + "TemperatureSensor1"), iri(ONTOLOGY + "TemperatureSensor2")
LOCATION = iri(ONTOLOGY + "location")


def located_streams(streams: dict[str, DataFrame], static: DataFrame, window: TimeWindow, ticks: Ticks) -> list[DataFrame]:
    """The four streams ``low1 low2 high1 high2`` by location; the second of each kind is annotated."""
    kinds = {"low1": LOW_1, "low2": LOW_2, "high1": HIGH_1, "high2": HIGH_2}
    out = []
    for name, df in streams.items():
        readings = observations(df, "sensor", vocab.MADE_BY, window, ticks, name.endswith("2"))
        out.append(by_location(readings, sensors_of(static, kinds[name], LOCATION)))
    return out


def located_errors(static: DataFrame) -> DataFrame:
    """Location with the class-wide errors of its unannotated sensors, ``mu1`` and ``mu3``."""
    low = p.cross(sensors_of(static, LOW_1, LOCATION).select("location"), class_errors(static, LOW_1, "mu1"))
    high = p.cross(sensors_of(static, HIGH_1, LOCATION).select("location"), class_errors(static, HIGH_1, "mu3"))
    return low.join(high, "location", "full")
