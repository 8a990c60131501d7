"""Registered queries: windows and continuous evaluation (C), batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.operators import patterns as p
from quadtide.operators import windows as w
from quadtide.operators.patterns import Pattern
from quadtide.plans.catalog import query
from quadtide.plans.catalog import sqltext as s
from quadtide.plans.catalog.views import event_ticks, hours, node
from quadtide.session import fresh_path
from quadtide.sources.tables import Tables
from quadtide.streaming import runner

_CONTENT = "CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total"


def _content_sql(every: int, tail: int, range_: int, step: int, where: str = "true") -> str:
    return f"""SELECT tick, {_CONTENT} FROM (SELECT tick, {s.upper(step)} AS up FROM {s.ticks(every, tail)})
 JOIN events ON ts >= up - INTERVAL {range_} HOUR AND ts < up WHERE {where} GROUP BY tick"""


def _content(t: Tables, every: int, tail: int, range_: int, step: int):
    ticks = event_ticks(t, every, tail)
    aggs = {"n": ("count", F.lit(1)), "total": ("sum", F.col("value"))}
    out = w.sliding_aggregate(t.events, "ts", hours(range_, step, ticks), ticks, [], aggs)
    return out.withColumn("total", F.round("total", 4))


query("C1_sliding_window", _content_sql(2, 6, 6, 1))(lambda t: _content(t, 2, 6, 6, 1))
query("C2_tumbling_window", _content_sql(4, 4, 4, 4))(lambda t: _content(t, 4, 4, 4, 4))
query("C3_window_with_gaps", _content_sql(3, 6, 2, 6))(lambda t: _content(t, 3, 6, 2, 6))
query("C5_every_finer_than_step", _content_sql(1, 5, 5, 3))(lambda t: _content(t, 1, 5, 5, 3))
query("C5_every_coarser_than_step", _content_sql(7, 5, 5, 2))(lambda t: _content(t, 7, 5, 5, 2))
query("C12_ticks_share_windows", _content_sql(1, 12, 12, 6))(lambda t: _content(t, 1, 12, 12, 6))


@query("C4_evaluation_ticks", f"SELECT tick, {s.upper(3)} AS upper, {s.upper(3)} - INTERVAL 6 HOUR AS lower FROM {s.ticks(2, 6)}")
def _c4(t: Tables):
    ticks = event_ticks(t, 2, 6)
    win = hours(6, 3, ticks)
    return ticks.frame(t.spark).select("tick", win.upper(F.col("tick")).alias("upper"), win.lower(F.col("tick")).alias("lower"))


@query(
    "C6_window_pattern_set_semantics",
    f"""SELECT DISTINCT tick, {node('place', 'user_id')} AS place, event_type AS kind
 FROM (SELECT tick, {s.upper(2)} AS up FROM {s.ticks(12, 24)}) JOIN events ON ts >= up - INTERVAL 24 HOUR AND ts < up""",
)
def _c6(t: Tables):
    # Every event reports the same statement about its place, so equal statements meet in a window.
    from quadtide.operators import quads as q
    from quadtide.plans.catalog.views import DATA, ont

    ticks = event_ticks(t, 12, 24)
    stream = q.table_quads(
        t.events, q.subject(DATA + "place/%s", F.col("user_id")),
        {ont("reports"): q.text_value(F.col("event_type"))}, keep=["ts"],
    )
    placed = w.distinct_spans(w.spans(stream, "ts", hours(24, 2, ticks), ticks), q.KEY)
    found = p.match(placed, Pattern("?place", ont("reports"), "?k"), keep=[w.LO, w.HI])
    return w.unfold(found, ticks).select("tick", "place", terms.lex(F.col("k")).alias("kind"))


@query(
    "C7_multi_window_join",
    f"""WITH tk AS (SELECT tick, {s.upper(1)} AS u1, {s.upper(3)} AS u2 FROM {s.ticks(2, 9)})
SELECT tick, a.user_id, a.event_id AS first, b.event_id AS second FROM tk
 JOIN events a ON a.ts >= u1 - INTERVAL 4 HOUR AND a.ts < u1 AND a.event_type = 'click'
 JOIN events b ON b.ts >= u2 - INTERVAL 9 HOUR AND b.ts < u2 AND b.event_type = 'purchase' AND a.user_id = b.user_id""",
)
def _c7(t: Tables):
    ticks = event_ticks(t, 2, 9)
    side = lambda kind, name: t.events.where(F.col("event_type") == kind).select("ts", "user_id", F.col("event_id").alias(name))
    parts = [(side("click", "first"), "ts", hours(4, 1, ticks)), (side("purchase", "second"), "ts", hours(9, 3, ticks))]
    return w.join_windows(parts, [["user_id"]], ticks)


@query(
    "C8_window_and_static",
    f"""SELECT tick, c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n
 FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(6, 12)}) JOIN events ON ts >= up - INTERVAL 12 HOUR AND ts < up
 JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0 GROUP BY ALL""",
)
def _c8(t: Tables):
    ticks = event_ticks(t, 6, 12)
    static = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    known = t.events.select("ts", "user_id").join(static, "user_id")
    return w.sliding_aggregate(known, "ts", hours(12, 1, ticks), ticks, ["segment"], {"n": ("count", F.lit(1))})


@query(
    "C9_full_result_each_tick",
    f"""SELECT tick, event_id, user_id FROM (SELECT tick, {s.upper(1)} AS up FROM {s.ticks(1, 3)})
 JOIN events ON ts >= up - INTERVAL 3 HOUR AND ts < up WHERE value > 150""",
)
def _c9(t: Tables):
    ticks = event_ticks(t, 1, 3)
    rows = t.events.where(F.col("value") > 150).select("ts", "event_id", "user_id")
    return w.window_rows(rows, "ts", hours(3, 1, ticks), ticks).drop("ts")


@query(
    "C10_one_shot",
    """SELECT TIMESTAMP '2024-01-15 13:20:00' AS tick, event_id, value FROM events
 WHERE ts >= TIMESTAMP '2024-01-15 01:00:00' AND ts < TIMESTAMP '2024-01-15 13:00:00'""",
)
def _c10(t: Tables):
    ticks = w.Ticks.once("2024-01-15 13:20:00")
    window = w.TimeWindow.of("PT12H", "PT1H", "2024-01-01")
    return w.window_rows(t.events.select("ts", "event_id", "value"), "ts", window, ticks).drop("ts")


@query(
    "C15_base_and_windows",
    f"""SELECT tick, source, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT tick, 'window' AS source FROM (SELECT tick, {s.upper(6)} AS up FROM {s.ticks(24, 24)}) JOIN events ON ts >= up - INTERVAL 24 HOUR AND ts < up
 UNION ALL SELECT tick, 'base' FROM {s.ticks(24, 24)}, customer) GROUP BY ALL""",
)
def _c15(t: Tables):
    ticks = event_ticks(t, 24, 24)
    window = hours(24, 6, ticks)
    rows = w.spans(t.events.select("ts", F.lit("window").alias("source")), "ts", window, ticks).drop("ts")
    base = w.everywhere(t.customer.select(F.lit("base").alias("source")), ticks)
    return w.sliding_aggregate(rows.unionByName(base), "ts", window, ticks, ["source"], {"n": ("count", F.lit(1))})


@query(
    "C17_elements_between",
    """SELECT event_id, event_type, value FROM events
 WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
)
def _c17(t: Tables):
    return w.elements_between(t.events, "ts", "2024-01-10 06:00:00", "2024-01-12 18:00:00").select("event_id", "event_type", "value")


# Streaming: the same windows over readStream; rows come out when the watermark has passed a tick, and
# the last ones when the stream has ended.


def _continuous(t: Tables, every: int, range_: int):
    """Ticks without an end from the first day of the data, and a window that slides by an hour."""
    ticks = w.Ticks(event_ticks(t, every, 0).start, w.micros(f"PT{every}H"))
    return ticks, hours(range_, 1, ticks)


def _side(t: Tables, kind: str, columns: list, ends: str):
    ticks, window = _continuous(t, 2, 6)
    df = t.stream("events").where(F.col("event_type") == kind).select("ts", "user_id", *columns)
    return runner.stream_window(runner.with_end(df, ends), "ts", window, ticks, "PT1H")


@query(
    "C1_sliding_window_streaming",
    f"""SELECT tick, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total
 FROM (SELECT tick FROM {s.ticks(2, 24)}) JOIN events ON ts >= tick - INTERVAL 6 HOUR AND ts < tick GROUP BY ALL""",
)
def _stream_content(t: Tables):
    (ticks, window), ends = _continuous(t, 2, 6), runner.end_folder(t.spark)
    stream = runner.with_end(t.stream("events").select("ts", "event_type", "value"), ends)
    rows = runner.stream_window(stream, "ts", window, ticks, "PT1H")
    out = rows.groupBy("tick", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return runner.drain(t.spark, out, "content", ends)


@query(
    "C7_multi_window_join_streaming",
    f"""SELECT tick, a.user_id, a.event_id AS first, b.event_id AS second FROM {s.ticks(2, 24)}
 JOIN events a ON a.ts >= tick - INTERVAL 6 HOUR AND a.ts < tick AND a.event_type = 'click'
 JOIN events b ON b.ts >= tick - INTERVAL 6 HOUR AND b.ts < tick AND b.event_type = 'purchase' AND a.user_id = b.user_id""",
)
def _stream_join(t: Tables):
    (ticks, window), ends = _continuous(t, 2, 6), runner.end_folder(t.spark)

    def side(kind: str, name: str):
        df = t.stream("events").where(F.col("event_type") == kind).select("ts", "user_id", F.col("event_id").alias(name))
        return runner.with_end(df, ends), window

    joined = runner.join_stream_windows(side("click", "first"), side("purchase", "second"), ["user_id"], ticks, "PT1H")
    return runner.drain(t.spark, joined, "join", ends)


@query(
    "C8_window_and_static_streaming",
    f"""SELECT tick, c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM {s.ticks(6, 24)}
 JOIN events ON ts >= tick - INTERVAL 12 HOUR AND ts < tick JOIN customer ON c_custkey = user_id GROUP BY ALL""",
)
def _stream_static(t: Tables):
    (ticks, window), ends = _continuous(t, 6, 12), runner.end_folder(t.spark)
    static = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    known = t.stream("events").select("ts", "user_id").join(static, "user_id").select("ts", "segment")
    rows = runner.stream_window(runner.with_end(known, ends), "ts", window, ticks, "PT1H")
    out = rows.groupBy("tick", "segment").agg(F.count(F.lit(1)).alias("n"))
    return runner.drain(t.spark, out, "static", ends)


@query(
    "F18_aggregate_after_stream_join",
    f"""SELECT tick, CAST(count(*) AS BIGINT) AS pairs FROM {s.ticks(2, 24)}
 JOIN events a ON a.ts >= tick - INTERVAL 6 HOUR AND a.ts < tick AND a.event_type = 'click'
 JOIN events b ON b.ts >= tick - INTERVAL 6 HOUR AND b.ts < tick AND b.event_type = 'purchase' AND a.user_id = b.user_id
 GROUP BY tick""",
)
def _stream_join_agg(t: Tables):
    ends = runner.end_folder(t.spark)
    joined = _side(t, "click", [], ends).join(_side(t, "purchase", [], ends), ["tick", "user_id"])
    out = joined.groupBy("tick").agg(F.count(F.lit(1)).alias("pairs"))
    return runner.drain(t.spark, out, "joinagg", ends)


_STREAM_SIDES = f"""WITH tk AS (SELECT tick FROM {s.ticks(2, 24)}),
 a AS (SELECT tick, user_id, event_id FROM tk JOIN events ON ts >= tick - INTERVAL 6 HOUR AND ts < tick WHERE event_type = 'click'),
 b AS (SELECT tick, user_id, event_id FROM tk JOIN events ON ts >= tick - INTERVAL 6 HOUR AND ts < tick WHERE event_type = 'purchase')"""


def _stream_sides(t: Tables):
    ends = runner.end_folder(t.spark)
    return *[_side(t, kind, [F.col("event_id").alias(n)], ends) for kind, n in (("click", "first"), ("purchase", "second"))], ends


@query("E4_optional_streaming", f"{_STREAM_SIDES} SELECT tick, user_id, a.event_id AS first, b.event_id AS second FROM a LEFT JOIN b USING (tick, user_id)")
def _stream_optional(t: Tables):
    first, second, ends = _stream_sides(t)
    return runner.drain(t.spark, runner.optional_stream(first, second, ["user_id"]), "optional", ends)


@query("E6_minus_streaming", f"{_STREAM_SIDES} SELECT tick, user_id, event_id AS first FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tick = a.tick AND b.user_id = a.user_id)")
def _stream_minus(t: Tables):
    first, second, ends = _stream_sides(t)
    return runner.drain(t.spark, runner.minus_stream(first, second, ["user_id"]), "minus", ends)


# Rows that arrive out of order. The table is replayed in parts; a part is a micro-batch.


def _replayed(t: Tables, part, parts: int):
    """Contents of six-hour windows over the events, which arrive in the order of ``part``."""
    (ticks, window), ends = _continuous(t, 2, 6), runner.end_folder(t.spark)
    folder, rows = fresh_path(t.spark, "arriving"), t.events.select("ts", "value", part.alias("part"))
    rows.where("false").drop("part").write.parquet(folder)
    stream = t.spark.readStream.schema(rows.drop("part").schema).parquet(folder)
    seen = runner.stream_window(runner.with_end(stream, ends), "ts", window, ticks, "PT1H")
    out = seen.groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    arriving = [rows.where(F.col("part") == n).drop("part") for n in range(parts)]
    return runner.replay(t.spark, out, folder, arriving, "replay", ends)


def _days(start, n: int):
    return F.floor((F.unix_micros("ts") - F.lit(start)) / (n * w.micros("P1D"))).cast("int")


@query("C11_out_of_order_rows", _content_sql(2, 6, 6, 1))
def _c11(t: Tables):
    # Every row is up to 50 minutes late, within the hour allowed, so parts overlap in time.
    start, late = event_ticks(t, 2, 0).start, F.pmod(F.xxhash64("event_id"), F.lit(w.micros("PT50M")))
    arrival = F.unix_micros("ts") + late - F.lit(start)
    return _replayed(t, F.least(F.floor(arrival / w.micros("P8D")), F.lit(3)).cast("int"), 4)


@query(
    "C11_rows_behind_the_watermark",
    f"""WITH first AS (SELECT date_trunc('day', min(ts)) AS day FROM events),
 e AS (SELECT ts, value, date_diff('day', day, ts) // 6 + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS part FROM events, first),
 seen AS (SELECT tick, value, part FROM {s.ticks(2, 24)} JOIN e ON ts >= tick - INTERVAL 6 HOUR AND ts < tick),
 mark AS (SELECT part, max(tick) - INTERVAL 8 HOUR AS closed FROM seen GROUP BY part)
SELECT tick, {_CONTENT} FROM seen
WHERE tick > coalesce((SELECT max(closed) FROM mark WHERE mark.part < seen.part), TIMESTAMP '1970-01-01') GROUP BY tick""",
)
def _c11_late(t: Tables):
    # One row in 97 comes two parts, twelve days, late: its evaluations are closed unless they are the last.
    late = F.when(F.col("event_id") % 97 == 0, 2).otherwise(0)
    return _replayed(t, _days(event_ticks(t, 2, 0).start, 6) + late, 8)
