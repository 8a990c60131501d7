"""The continuous monitoring queries over observation tables.

An observation table has ``ts`` (or the span columns of a window), a join key, ``value`` and, where readings are annotated, a
distribution struct ``unc``. Each function names its windows; results carry the evaluation ``tick``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let
from quadtide.operators.windows import (
    Ticks, TimeWindow, join_many, join_spans, join_windows, placed, sliding_aggregate, time_columns, unfold,
)


def shifted(unc: str, value: str) -> u.Uncertain:
    """A reading as a random value: its error distribution moved by the reported number."""
    return u.add(u.from_struct(F.col(unc)), F.col(value))


def probably_low_while_hot(
    low: DataFrame, hot: DataFrame, key: str, window: TimeWindow, ticks: Ticks,
    limit: float, probability: float, hot_above: float, hot_first: bool = False,
) -> DataFrame:
    """Two windows on one key: P(value1 + error < limit) >= probability and value2 > hot_above."""
    first = low.where(u.less_than(shifted("unc", "value"), limit) >= probability)
    first = first.select(*time_columns(first), key, F.col("value").alias("value1"))
    second = hot.where(F.col("value") > hot_above).select(*time_columns(hot), key, F.col("value").alias("value2"))
    parts = [(first, "ts", window), (second, "ts", window)]
    out = join_windows(parts[::-1] if hot_first else parts, [[key]], ticks)
    return out.select("tick", key, "value1", "value2")


def low_probability_while_hot(
    low: DataFrame, hot: DataFrame, key: str, window: TimeWindow, ticks: Ticks,
    limit: float, below: float, hot_above: float, hot_first: bool = False,
) -> DataFrame:
    """The same join, with the probability as an output column and plain filters on both sides."""
    first = low.where(F.col("value") < below).withColumn("p", u.less_than(shifted("unc", "value"), limit))
    first = first.select(*time_columns(first), key, F.col("value").alias("value1"), "p")
    second = hot.where(F.col("value") > hot_above).select(*time_columns(hot), key, F.col("value").alias("value2"))
    parts = [(first, "ts", window), (second, "ts", window)]
    out = join_windows(parts[::-1] if hot_first else parts, [[key]], ticks)
    return out.select("tick", key, "value1", "value2", "p")


def four_streams(
    streams: list[DataFrame], sensors: DataFrame, key: str, window: TimeWindow, ticks: Ticks,
    low_limit: float, low_below: float, high_limit: float, high_above: float,
    probability: float | None, reverse: bool = False,
) -> DataFrame:
    """Two "low" and two "high" streams of one place.

    ``sensors`` has the key and the class-wide distributions ``mu1`` (first low stream) and ``mu3``
    (first high stream); the second stream of each kind carries its own ``unc`` per reading. With a
    probability the four chances are filters, without one they are output columns p1..p4.
    """
    parts = []
    for i, df in enumerate(streams, start=1):
        value, unc = f"value{i}", "unc"
        if i in (1, 3):
            df = df.drop("unc").join(sensors.select(key, F.col(f"mu{i}").alias("unc")), key)
        reading = shifted(unc, "value")
        if i <= 2:
            df, p = df.where(F.col("value") < low_below), u.less_than(reading, low_limit)
        else:
            df, p = df.where(F.col("value") > high_above), u.greater_than(reading, high_limit)
        if probability is None:
            df = df.withColumn(f"p{i}", p)
        else:
            df = df.where(p >= probability)
        extra = [f"p{i}"] if probability is None else []
        parts.append((df.select(*time_columns(df), key, F.col("value").alias(value), *extra), "ts", window))
    out = join_windows(parts[::-1] if reverse else parts, [[key]] * 3, ticks)
    chances = [f"p{i}" for i in range(1, 5)] if probability is None else []
    return out.select("tick", key, *[f"value{i}" for i in range(1, 5)], *chances)


def readings_differ(
    first: DataFrame, second: DataFrame, third: DataFrame, mu1: Column, key: str, window: TimeWindow,
    ticks: Ticks, hot_above: float, probability: float | None, reverse: bool = False,
) -> DataFrame:
    """Two uncertain readings of one place differ, while a third stream is above a limit.

    ``mu1`` is the error of every reading of the first stream.
    """
    a = first.select(*time_columns(first), key, F.col("value").alias("value1"), mu1.alias("__u1"))
    b = second.select(*time_columns(second), key, F.col("value").alias("value2"), F.col("unc").alias("__u2"))
    c = third.where(F.col("value") > hot_above).select(*time_columns(third), key, F.col("value").alias("value3"))
    parts = [(a, "ts", window), (b, "ts", window), (c, "ts", window)]
    longest = window.max_ticks(ticks)
    shown = [placed(*part, ticks) for part in parts]
    joined = join_many(shown[::-1] if reverse else shown, [key], longest)
    x, y = shifted("__u1", "value1"), shifted("__u2", "value2")
    joined = joined.withColumns({"p1": u.less_than(x, y), "p2": u.greater_than(x, y)})
    out = ["tick", key, "value1", "value2", "value3"]
    if probability is None:
        out += ["p1", "p2"]
    else:
        joined = joined.where((F.col("p1") >= probability) | (F.col("p2") >= probability))
    return unfold(joined.drop("__u1", "__u2"), ticks).select(*out)


def linked_events(
    events: DataFrame, links: DataFrame, targets: DataFrame, window: TimeWindow, ticks: Ticks,
    thresholds: list[float], probability: float = 0.5,
) -> DataFrame:
    """Two windows joined through a link table, for several thresholds in one pass.

    ``events``: ts, id, value, unc. ``links``: id, prop, target. ``targets``: ts, target, value.
    """
    reading = shifted("unc", "value")
    passed = F.array_compact(F.array(*[F.when(u.less_than(reading, t) >= probability, F.lit(float(t))) for t in thresholds]))
    # A row is joined once, whatever number of thresholds it passes, and multiplied at the end.
    kept = let(events, passed=passed).where(F.size("passed") > 0)
    kept = kept.select(*time_columns(events), "id", F.col("value").alias("value1"), "passed")
    kept = placed(kept, "ts", window, ticks).join(links, "id")
    other = targets.select(*time_columns(targets), "target", F.col("value").alias("value2"))
    other = placed(other, "ts", window, ticks)
    out = join_spans(kept, other, ["target"], window.max_ticks(ticks))
    out = out.withColumn("threshold", F.explode("passed"))
    return unfold(out, ticks).select("tick", "prop", "threshold", "id", "target", "value1", "value2")


def window_averages(
    parts: dict[str, tuple[DataFrame, TimeWindow]], key: str, ticks: Ticks
) -> DataFrame:
    """Average of each stream per key and tick; only keys that all streams report at a tick."""
    out = None
    for name, (df, window) in parts.items():
        one = sliding_aggregate(df, "ts", window, ticks, [key], {name: ("avg", F.col("value"))})
        out = one if out is None else out.join(one, ["tick", key])
    return out

