import pytest
from pyspark.sql import functions as F

from quadtide.functions import registry
from quadtide.functions import scalars as k
from quadtide.functions import terms
from quadtide.vocab import XSD


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "expr, want",
    [
        (lambda: k.round_(F.lit(-2.5)), -2.0), (lambda: k.round_(F.lit(2.5)), 3.0), (lambda: k.ceil(F.lit(-0.5)), 0.0),
        (lambda: k.substr(F.lit("foobar"), 4), "bar"), (lambda: k.substr(F.lit("foobar"), 0, 3), "fo"), (lambda: k.substr(F.lit("foobar"), -1, 3), "f"),
        (lambda: k.before(F.lit("abc"), "b"), "a"), (lambda: k.before(F.lit("abc"), "x"), ""), (lambda: k.after(F.lit("abc"), "b"), "c"),
        (lambda: k.after(F.lit("abc"), "x"), ""), (lambda: k.after(F.lit("abc"), ""), "abc"), (lambda: k.before(F.lit(None).cast("string"), "x"), None),
        (lambda: k.encode_for_uri(F.lit("Los Angeles*~/é")), "Los%20Angeles%2A~%2F%C3%A9"),
        (lambda: k.regex(F.lit("a.c"), "A.C", "iq"), True), (lambda: k.regex(F.lit("abc"), "A.C", "q"), False),
        (lambda: k.replace(F.lit("abcb"), "b", "Z"), "aZcZ"), (lambda: k.divide(F.lit(1), F.lit(0)), None),
        (lambda: k.timezone(F.lit("2011-01-10T14:45:13.815-05:00")), "-PT5H"), (lambda: k.timezone(F.lit("2011-01-10T14:45:13Z")), "PT0S"),
        (lambda: k.timezone(F.lit("2011-01-10T14:45:13")), None), (lambda: k.tz(F.lit("2011-01-10T14:45:13")), ""),
        (lambda: k.seconds(F.lit("2011-01-10T14:45:13.815Z")), 13.815), (lambda: k.hours(F.lit("2011-01-10T14:45:13-05:00")), 14),
        (lambda: k.compare_durations(F.lit("P1D"), F.lit("PT24H")), 0), (lambda: k.compare_durations(F.lit("P1Y"), F.lit("P13M")), -1),
        (lambda: k.compare_durations(F.lit("P1M"), F.lit("P30D")), None), (lambda: k.compare_durations(F.lit("-PT1H"), F.lit("PT0S")), -1),
        (lambda: k.if_(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)), None), (lambda: terms.lang_matches(F.lit("en-gb"), "en"), True),
        (lambda: terms.lang_matches(F.lit(""), "*"), False), (lambda: k.iri(F.lit("?q"), "http://h/a/b?x#y"), "<http://h/a/b?q>"),
        (lambda: k.iri(F.lit("c"), "http://h"), "<http://h/c>"), (lambda: k.iri(F.lit("//o/c"), "http://h/a"), "<http://o/c>"),
    ],
)
def test_edges(spark, expr, want):
    assert one(spark, expr()) == want


def test_compare_terms(spark):
    def term(lex, dt=None):
        return F.lit(f'"{lex}"' + (f"^^<{XSD}{dt}>" if dt else ""))

    assert one(spark, k.compare_terms(term("1", "integer"), "=", term("1.0", "decimal"))) is True
    assert one(spark, k.compare_terms(term("1", "integer"), "<", term("a"))) is None
    assert one(spark, k.compare_terms(term("a"), "<", term("b"))) is True
    assert one(spark, k.compare_terms(term("1", "integer"), "=", term("a"))) is None
    assert one(spark, k.compare_terms(F.lit("<a>"), "!=", term("a"))) is True
    assert one(spark, k.compare_terms(F.lit("<a>"), "=", F.lit("<a>"))) is True


def test_value_spaces_of_comparisons(spark):
    def typed(lex, dt):
        return F.lit(f'"{lex}"^^<{XSD}{dt}>')

    noon, date, en, de = typed("2024-01-01T12:00:00Z", "dateTime"), typed("2024-01-01", "date"), F.lit('"a"@en'), F.lit('"a"@de')
    hour, month = typed("PT60M", "dayTimeDuration"), typed("P1M", "yearMonthDuration")
    cases = [
        (date, "=", typed("2024-01-01T00:00:00", "dateTime"), None), (date, "<", noon, None), (date, "<", typed("2024-01-02", "date"), True),
        (noon, "=", typed("2024-01-01T13:00:00+01:00", "dateTime"), True), (noon, "=", typed("2024-01-01T12:00:00", "dateTime"), None),
        (noon, "<", typed("2024-01-02T02:00:00", "dateTime"), None), (noon, "<", typed("2024-01-02T02:00:01", "dateTime"), True),
        (noon, "!=", typed("2024-01-05T00:00:00", "dateTime"), True), (hour, "=", typed("PT1H", "dayTimeDuration"), True),
        (hour, "<", typed("P1D", "duration"), True), (hour, "<", month, None), (month, ">=", typed("P1Y", "yearMonthDuration"), False),
        (en, "=", en, True), (en, "=", de, False), (en, "!=", de, True), (en, "<", de, None), (en, "=", F.lit('"a"'), None),
    ]
    got = spark.range(1).select(*[k.compare_terms(a, op, b).alias(f"c{i}") for i, (a, op, b, _) in enumerate(cases)]).first()
    assert list(got) == [want for *_, want in cases]


def test_effective_boolean_value(spark):
    cases = {'"true"^^<%sboolean>' % XSD: True, '"0"^^<%sinteger>' % XSD: False, '""': False, '"x"@en': True, "<http://a>": None}
    for text, want in cases.items():
        assert one(spark, terms.ebv(F.lit(text))) is want


def test_registry(spark):
    registry.register("http://f/inc", lambda x: x + 1)
    assert one(spark, registry.call("http://f/inc", F.lit(1))) == 2
    assert one(spark, registry.call(XSD + "integer", F.lit("x"))) is None
    with pytest.raises(KeyError):
        registry.call("http://f/none")
    registry.register_aggregate("http://f/agg", lambda x: F.max(x))
    assert one(spark, registry.aggregate("http://f/agg", F.col("id"))) == 0


def test_rounding_of_extremes(spark):
    values = [1e20, -1e20, float("inf"), float("-inf"), 2.0**53, -2.5, 2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(k.ceil(F.col("x")), k.floor(F.col("x")), k.round_(F.col("x"))).collect()
    assert [tuple(r) for r in got[:5]] == [(v,) * 3 for v in values[:5]]
    assert [tuple(r) for r in got[5:]] == [(-2.0, -3.0, -2.0), (3.0, 2.0, 3.0), (None,) * 3]
    nan = spark.range(1).select(k.floor(F.lit(float("nan")))).first()[0]
    assert nan != nan


def test_absent_parts_of_durations_are_not_cast():
    # Empty text is no decimal, and finding that out by an exception for every row takes most of the time.
    assert str(k.day_time_duration(F.col("d"))).count("nullif") >= 4
