"""The twelve monitoring queries, the fan-out sweep and the averages-over-windows alert."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide import vocab
from quadtide.functions import terms
from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let
from quadtide.operators import patterns as p
from quadtide.operators import quads as q
from quadtide.plans import monitoring as m
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.plans.catalog.views import DATA, STREAM_TYPES, event_quads, event_ticks, hours, node, ont, reading, reading_sql
from quadtide.plans.observations import observations
from quadtide.sources.tables import Tables


def _in(alias: str, range_: int, up: str) -> str:
    return f"{alias}.ts >= {up} - INTERVAL {range_} HOUR AND {alias}.ts < {up}"


def _tick_cte(every: int, tail: int, step: int) -> str:
    return f"tk AS (SELECT tick, {s.upper(step)} AS up FROM {s.ticks(every, tail)})"


_Q1_SQL = f"""WITH {_tick_cte(2, 6, 1)},
 a AS (SELECT * FROM {reading_sql('low2')} WHERE {s.cdf('kind', 'a + value', 'b', '40 - 1e-7')} >= 0.5),
 b AS (SELECT * FROM {reading_sql('high2')} WHERE value > 30)
SELECT tick, a.place, a.value AS value1, b.value AS value2
FROM tk JOIN a ON {_in('a', 6, 'up')} JOIN b ON {_in('b', 6, 'up')} AND a.place = b.place"""


def _q1(t: Tables, hot_first: bool):
    ticks = event_ticks(t, 2, 6)
    return m.probably_low_while_hot(
        reading(t, "low2"), reading(t, "high2", False), "place", hours(6, 1, ticks), ticks, 40.0, 0.5, 30.0, hot_first
    )


query("Q1a_filter_two_windows", _Q1_SQL)(lambda t: _q1(t, False))
query("Q1b_filter_two_windows_inverted", _Q1_SQL)(lambda t: _q1(t, True))

_Q4_SQL = f"""WITH {_tick_cte(2, 6, 1)},
 a AS (SELECT *, {s.cdf('kind', 'a + value', 'b', '40 - 1e-7')} AS p FROM {reading_sql('low2')} WHERE value < 60),
 b AS (SELECT * FROM {reading_sql('high2')} WHERE value > 30)
SELECT tick, a.place, a.value AS value1, b.value AS value2, round(p, 6) AS p
FROM tk JOIN a ON {_in('a', 6, 'up')} JOIN b ON {_in('b', 6, 'up')} AND a.place = b.place"""


def _q4(t: Tables, hot_first: bool):
    ticks = event_ticks(t, 2, 6)
    out = m.low_probability_while_hot(
        reading(t, "low2"), reading(t, "high2", False), "place", hours(6, 1, ticks), ticks, 40.0, 60.0, 30.0, hot_first
    )
    return out.withColumn("p", F.round("p", 6))


query("Q4a_bind_two_windows", _Q4_SQL)(lambda t: _q4(t, False))
query("Q4b_bind_two_windows_inverted", _Q4_SQL)(lambda t: _q4(t, True))


def _sensors(t: Tables):
    """Static side: every customer is a place, its class-wide errors depend on its segment."""
    half = F.length("c_mktsegment").cast("double")
    return t.customer.select(
        F.col("c_custkey").alias("place"),
        u.uniform(-half, half).struct().alias("mu1"),
        u.normal(F.lit(0.0), half * half).struct().alias("mu3"),
    )


def _four_sql(bind: bool) -> str:
    half = "CAST(length(c_mktsegment) AS DOUBLE)"
    p1 = s.cdf("'U'", "r.value - h", "r.value + h", "60 - 1e-7")
    p2 = s.cdf("'N'", "r.value", "r.b", "60 - 1e-7")
    p3 = f"(1 - {s.cdf(chr(39) + 'N' + chr(39), 'r.value', 'h * h', '20 + 1e-7')})"
    p4 = f"(1 - {s.cdf(chr(39) + 'N' + chr(39), 'r.value', 'r.b', '20 + 1e-7')})"
    static = f"(SELECT c_custkey, {half} AS h FROM customer)"

    def part(name: str, p: str, cond: str, joined: bool) -> str:
        src = f"{reading_sql(name)} r" + (f" JOIN {static} c ON c.c_custkey = r.place" if joined else "")
        keep = "" if bind else f" AND {p} >= 0.4"
        return f"(SELECT r.ts, r.place, r.value, {p} AS p FROM {src} WHERE r.value {cond}{keep})"

    chances = ", " + ", ".join(f"round(r{i}.p, 6) AS p{i}" for i in range(1, 5)) if bind else ""
    return f"""WITH {_tick_cte(8, 24, 1)},
 r1 AS {part('low1', p1, '< 80', True)}, r2 AS {part('low2', p2, '< 80', False)},
 r3 AS {part('high1', p3, '> 5', True)}, r4 AS {part('high2', p4, '> 5', False)}
SELECT tick, r1.place, r1.value AS value1, r2.value AS value2, r3.value AS value3, r4.value AS value4{chances}
FROM tk JOIN r1 ON {_in('r1', 24, 'up')} JOIN r2 ON {_in('r2', 24, 'up')} AND r2.place = r1.place
 JOIN r3 ON {_in('r3', 24, 'up')} AND r3.place = r1.place JOIN r4 ON {_in('r4', 24, 'up')} AND r4.place = r1.place"""


def _four(t: Tables, probability: float | None, reverse: bool):
    ticks = event_ticks(t, 8, 24)
    streams = [reading(t, n) for n in ("low1", "low2", "high1", "high2")]
    out = m.four_streams(
        streams, _sensors(t), "place", hours(24, 1, ticks), ticks, 60.0, 80.0, 20.0, 5.0, probability, reverse
    )
    if probability is None:
        out = out.withColumns({f"p{i}": F.round(f"p{i}", 6) for i in range(1, 5)})
    return out


query("Q2a_filter_four_windows_static", _four_sql(False))(lambda t: _four(t, 0.4, False))
query("Q2b_filter_four_windows_static_inverted", _four_sql(False))(lambda t: _four(t, 0.4, True))
query("Q5a_bind_four_windows_static", _four_sql(True))(lambda t: _four(t, None, False))
query("Q5b_bind_four_windows_static_inverted", _four_sql(True))(lambda t: _four(t, None, True))


def _differ_sql(bind: bool) -> str:
    p1 = f"(1 - {s.less_nu('r2.value', 'r2.b', '(r1.value-10)', '(r1.value+10)')})"
    cols = "abs(round(p1, 6)) AS p1, abs(round(1 - p1, 6)) AS p2" if bind else ""
    where = "" if bind else "WHERE p1 >= 0.7 OR 1 - p1 >= 0.7"
    return f"""WITH {_tick_cte(12, 12, 12)},
 r1 AS {reading_sql('low1')}, r2 AS {reading_sql('low2')}, r3 AS (SELECT * FROM {reading_sql('high1')} WHERE value > 10),
 j AS (SELECT tick, r1.place, r1.value AS value1, r2.value AS value2, r3.value AS value3, {p1} AS p1
  FROM tk JOIN r1 ON {_in('r1', 12, 'up')} JOIN r2 ON {_in('r2', 12, 'up')} AND r2.place = r1.place
  JOIN r3 ON {_in('r3', 12, 'up')} AND r3.place = r1.place)
SELECT tick, place, value1, value2, value3{', ' + cols if bind else ''} FROM j {where}"""


def _differ(t: Tables, probability: float | None, reverse: bool):
    ticks = event_ticks(t, 12, 12)
    mu1 = u.uniform(-10.0, 10.0).struct()
    out = m.readings_differ(
        reading(t, "low1"), reading(t, "low2"), reading(t, "high1"), mu1, "place",
        hours(12, 12, ticks), ticks, 10.0, probability, reverse,
    )
    if probability is None:
        out = out.withColumns({p: F.round(p, 6) for p in ("p1", "p2")})
    return out


query("Q3a_filter_compare_readings", _differ_sql(False))(lambda t: _differ(t, 0.7, False))
query("Q3b_filter_compare_readings_inverted", _differ_sql(False))(lambda t: _differ(t, 0.7, True))
query("Q6a_bind_compare_readings", _differ_sql(True))(lambda t: _differ(t, None, False))
query("Q6b_bind_compare_readings_inverted", _differ_sql(True))(lambda t: _differ(t, None, True))

# An order line links an event (by order key) to target events (by part key); the share of rows
# that find a partner differs per property.
_LINKS = {"join_001": 50, "join_01": 10, "join_1": 1}


@query(
    "Q7_linked_events_threshold_sweep",
    f"""WITH {_tick_cte(4, 10, 1)},
 th AS (SELECT unnest([10.0, 30.0, 50.0, 90.0]::DOUBLE[]) AS threshold),
 e AS (SELECT ts, event_id AS id, value FROM events WHERE event_type = 'click'),
 e2 AS (SELECT ts, event_id AS target, value FROM events WHERE event_type <> 'click'),
 lk AS (SELECT DISTINCT l_orderkey AS id, prop, target FROM (
   SELECT l_orderkey, 'join_001' AS prop, (l_orderkey + l_linenumber) * 50 AS target FROM lineitem
   UNION ALL SELECT l_orderkey, 'join_01', (l_orderkey + l_linenumber) * 10 FROM lineitem
   UNION ALL SELECT l_orderkey, 'join_1', l_orderkey + l_linenumber FROM lineitem))
SELECT tick, lk.prop, threshold, e.id, lk.target, e.value AS value1, e2.value AS value2
FROM tk JOIN e ON {_in('e', 10, 'up')}
 JOIN th ON {s.cdf("'U'", 'e.value - 20', 'e.value + 20', 'threshold - 1e-7')} >= 0.5
 JOIN lk ON lk.id = e.id JOIN e2 ON e2.target = lk.target AND {_in('e2', 10, 'up')}""",
)
def _sweep(t: Tables):
    ticks = event_ticks(t, 4, 10)
    unc = u.uniform(-20.0, 20.0).struct().alias("unc")
    events = t.events.where(F.col("event_type") == "click").select("ts", F.col("event_id").alias("id"), "value", unc)
    targets = t.events.where(F.col("event_type") != "click").select("ts", F.col("event_id").alias("target"), "value")
    # A property's targets follow from one number, so equal links are found before they are multiplied.
    numbers = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("number")).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), (F.col("number") * n).alias("target")) for p, n in _LINKS.items()]))
    links = numbers.select("id", pairs.alias("x")).select("id", "x.*")
    return m.linked_events(events, links, targets, hours(10, 1, ticks), ticks, [10.0, 30.0, 50.0, 90.0])


@query(
    "Q8_vitals_having",
    f"""WITH {_tick_cte(6, 48, 1)},
 ok AS (SELECT ts, user_id AS person, event_type, value FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 > 0.05),
 hr AS (SELECT tick, person, avg(value) AS v FROM tk JOIN ok ON {_in('ok', 48, 'up')} WHERE event_type = 'click' GROUP BY ALL),
 br AS (SELECT tick, person, avg(value) AS v FROM tk JOIN ok ON {_in('ok', 48, 'up')} WHERE event_type = 'view' GROUP BY ALL),
 ox AS (SELECT tick, person, avg(value) AS v FROM tk JOIN ok ON {_in('ok', 48, 'up')} WHERE event_type = 'purchase' GROUP BY ALL)
SELECT tick, person, c_mktsegment AS activity, round(hr.v, 8) AS avg_hr, round(br.v, 8) AS avg_br, round(ox.v, 8) AS avg_ox
FROM hr JOIN br USING (tick, person) JOIN ox USING (tick, person) JOIN customer ON c_custkey = person
WHERE hr.v > 40 + length(c_mktsegment) AND br.v < 70 - length(c_mktsegment) AND ox.v >= 5 AND ox.v <= 90""",
)
def _vitals(t: Tables):
    ticks = event_ticks(t, 6, 48)
    confidence = F.get_json_object("props", "$.k").cast("double") / 100.0
    sure = t.events.where(confidence > 0.05).select("ts", F.col("user_id").alias("person"), "event_type", "value")
    w = hours(48, 1, ticks)
    kinds = {"avg_hr": "click", "avg_br": "view", "avg_ox": "purchase"}
    parts = {n: (sure.where(F.col("event_type") == k), w) for n, k in kinds.items()}
    averages = m.window_averages(parts, "person", ticks)
    situation = t.customer.select(
        F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("activity"),
        F.length("c_mktsegment").alias("n"),
    )
    kept = averages.join(situation, "person").where(
        (F.col("avg_hr") > 40 + F.col("n")) & (F.col("avg_br") < 70 - F.col("n")) & F.col("avg_ox").between(5, 90)
    )
    rounded = [F.round(c, 8).alias(c) for c in ("avg_hr", "avg_br", "avg_ox")]
    return kept.select("tick", "person", "activity", *rounded)


# Over statement streams ---------------------------------------------------------------------------


def _by_node(sql: str, place: str) -> str:
    """The same results with the IRI of the place."""
    old = f"tick, {place},"
    assert sql.count(old) == 1
    return sql.replace(old, f"tick, {node('place', place)} AS place,")


def _observed(t: Tables, name: str, window, ticks, annotated: bool | None = None):
    """One stream of readings from its statements, each of which counts once per tick."""
    annotated = name.endswith("2") if annotated is None else annotated
    stream = event_quads(t, where=F.col("event_type") == STREAM_TYPES[name]).withColumnRenamed("ts", "elem_ts")
    return observations(stream, "place", vocab.FEATURE, window, ticks, annotated)


def _described_sensors(t: Tables):
    """The errors of ``_sensors``, from statements that describe every place."""
    half = F.length("c_mktsegment")
    literal = lambda *parts: q.term_value(F.concat(F.lit('"'), *parts, F.lit(f')"^^<{vocab.DISTRIBUTION}>')))
    h, square = half.cast("string"), (half * half).cast("string")
    static = q.table_quads(t.customer, q.subject(DATA + "place/%s", F.col("c_custkey")), {
        ont("lowError"): literal(F.lit("U(-"), h, F.lit(","), h), ont("highError"): literal(F.lit("N(0,"), square),
    })
    found = p.basic_pattern(static, [p.Pattern("?place", ont("lowError"), "?low"), p.Pattern("?place", ont("highError"), "?high")])
    found = let(found, mu1=u.parse(terms.lex(F.col("low"))), mu3=u.parse(terms.lex(F.col("high"))))
    return found.select("place", "mu1", "mu3")


@query("Q1a_filter_over_statements", _by_node(_Q1_SQL, "a.place"))
def _q1_statements(t: Tables):
    ticks = event_ticks(t, 2, 6)
    window = hours(6, 1, ticks)
    low, hot = _observed(t, "low2", window, ticks), _observed(t, "high2", window, ticks, False)
    return m.probably_low_while_hot(low, hot, "place", window, ticks, 40.0, 0.5, 30.0)


@query("Q4a_bind_over_statements", _by_node(_Q4_SQL, "a.place"))
def _q4_statements(t: Tables):
    ticks = event_ticks(t, 2, 6)
    window = hours(6, 1, ticks)
    low, hot = _observed(t, "low2", window, ticks), _observed(t, "high2", window, ticks, False)
    out = m.low_probability_while_hot(low, hot, "place", window, ticks, 40.0, 60.0, 30.0)
    return out.withColumn("p", F.round("p", 6))


def _four_statements(t: Tables, probability: float | None):
    ticks = event_ticks(t, 8, 24)
    window = hours(24, 1, ticks)
    streams = [_observed(t, n, window, ticks) for n in ("low1", "low2", "high1", "high2")]
    out = m.four_streams(streams, _described_sensors(t), "place", window, ticks, 60.0, 80.0, 20.0, 5.0, probability)
    return out if probability is not None else out.withColumns({f"p{i}": F.round(f"p{i}", 6) for i in range(1, 5)})


query("Q2a_filter_over_statements", _by_node(_four_sql(False), "r1.place"))(lambda t: _four_statements(t, 0.4))
query("Q5a_bind_over_statements", _by_node(_four_sql(True), "r1.place"))(lambda t: _four_statements(t, None))


def _differ_statements(t: Tables, probability: float | None):
    ticks = event_ticks(t, 12, 12)
    window = hours(12, 12, ticks)
    streams = [_observed(t, n, window, ticks) for n in ("low1", "low2", "high1")]
    out = m.readings_differ(*streams, u.uniform(-10.0, 10.0).struct(), "place", window, ticks, 10.0, probability)
    return out if probability is not None else out.withColumns({c: F.round(c, 6) for c in ("p1", "p2")})


query("Q3a_filter_over_statements", _by_node(_differ_sql(False), "place"))(lambda t: _differ_statements(t, 0.7))
query("Q6a_bind_over_statements", _by_node(_differ_sql(True), "place"))(lambda t: _differ_statements(t, None))
