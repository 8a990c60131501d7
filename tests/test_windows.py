import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadtide.operators import windows as w
from tests.conftest import rows

EPOCH = datetime(1970, 1, 1)


def ms(n):
    return EPOCH + timedelta(milliseconds=n)


@pytest.mark.parametrize(
    "t, ref, width, step, lower, upper",
    [
        (12345, 1000, 1000, 1000, 11000, 12000), (12345, 0, 10000, 1000, 2000, 12000), (16000, 0, 10000, 4000, 6000, 16000),
        (18000, 0, 10000, 4000, 6000, 16000), (9000, 0, 2000, 4000, 6000, 8000),
    ],
)
def test_bounds(spark, t, ref, width, step, lower, upper):
    window = w.TimeWindow(width * 1000, step * 1000, ref * 1000)
    df = spark.createDataFrame([(ms(t),)], "tick timestamp")
    got = df.select(window.lower(F.col("tick")).alias("l"), window.upper(F.col("tick")).alias("u")).first()
    assert (got.l, got.u) == (ms(lower), ms(upper))


def test_half_open_content(spark):
    times = spark.createDataFrame([(ms(93 * i),) for i in range(15)], "ts timestamp")
    window = w.TimeWindow(1_000_000, 1_000_000, 0)
    assert w.window_rows(times, "ts", window, w.Ticks.once(1_500_000)).count() == 11
    assert w.elements_between(times, "ts", 0, 1_000_000).count() == 11


def _brute(times, window, ticks):
    out = []
    for k in range(ticks.count):
        t = ticks.start + k * ticks.every
        up = t - (t - window.ref) % window.step
        out += [(ts, t) for ts in times if up - window.width <= ts < up]
    return sorted(out)


def test_spans_match_the_definition(spark):
    rng = random.Random(5)
    for _ in range(12):
        window = w.TimeWindow(rng.randint(1, 40), rng.randint(1, 40), rng.randint(0, 30))
        ticks = w.Ticks(rng.randint(0, 50), rng.randint(1, 25), rng.randint(1, 30))
        times = [rng.randint(0, 400) for _ in range(60)]
        df = spark.createDataFrame([(x,) for x in times], "u long").select(F.timestamp_micros("u").alias("ts"))
        got = w.window_rows(df, "ts", window, ticks).select(F.unix_micros("ts"), F.unix_micros("tick"))
        assert sorted(tuple(r) for r in got.collect()) == _brute(times, window, ticks)


def test_join_windows_matches_the_definition(spark):
    rng = random.Random(6)
    for _ in range(6):
        w1 = w.TimeWindow(rng.randint(1, 40), rng.randint(1, 20), 0)
        w2 = w.TimeWindow(rng.randint(1, 80), rng.randint(1, 20), 3)
        ticks = w.Ticks(10, rng.randint(1, 12), 40)
        left = [(rng.randint(0, 400), rng.choice("aab")) for _ in range(50)]
        right = [(rng.randint(0, 400), rng.choice("aac")) for _ in range(50)]
        want = []
        for lt, lk in left:
            seen = {t for _, t in _brute([lt], w1, ticks)}
            for rt, rk in right:
                if lk == rk:
                    want += [(t, lk, lt, rt) for _, t in _brute([rt], w2, ticks) if t in seen]

        def table(data, name):
            df = spark.createDataFrame(data, "u long, k string")
            return df.select(F.timestamp_micros("u").alias("ts"), "k", F.col("u").alias(name))

        out = w.join_windows([(table(left, "l"), "ts", w1), (table(right, "r"), "ts", w2)], [["k"]], ticks)
        got = [tuple(r) for r in out.select(F.unix_micros("tick"), "k", "l", "r").collect()]
        assert sorted(got) == sorted(want)


def test_join_of_four_windows_at_once(spark):
    rng = random.Random(12)
    ticks = w.Ticks.at(0, "PT0.05S", 30)
    windows = [w.TimeWindow(width * 1000, step * 1000, 0) for width, step in ((300, 50), (170, 30), (500, 100), (60, 60))]
    data = [[(ms(rng.randint(0, 1500)), rng.choice("aab"), n) for n in range(24)] for _ in windows]
    frames = [spark.createDataFrame(d, f"ts timestamp, key string, n{i} long") for i, d in enumerate(data)]
    got = w.join_windows([(f, "ts", window) for f, window in zip(frames, windows)], [["key"]] * 3, ticks)
    want = []
    for k in range(ticks.count):
        t = k * 50
        shown = [[r for r in d if t - t % (x.step // 1000) - x.width // 1000 <= (r[0] - EPOCH) / timedelta(milliseconds=1) < t - t % (x.step // 1000)] for d, x in zip(data, windows)]
        want += [(ms(t), a[1], a[2], b[2], c[2], d[2]) for a in shown[0] for b in shown[1] for c in shown[2] for d in shown[3] if a[1] == b[1] == c[1] == d[1]]
    assert len(want) > 100
    assert rows(got.select(F.col("tick").cast("timestamp_ntz"), "key", "n0", "n1", "n2", "n3")) == sorted(want, key=lambda r: tuple((False, str(x)) for x in r))


def test_distinct_spans_show_a_key_once_per_tick(spark):
    times = [0, 1, 5, 5, 17, 30, 31]
    df = spark.createDataFrame([(x,) for x in times], "u long").select(F.timestamp_micros("u").alias("ts"), F.lit("q").alias("k"))
    window, ticks = w.TimeWindow(10, 1, 0), w.Ticks(0, 1, 60)
    got = w.unfold(w.distinct_spans(w.spans(df, "ts", window, ticks), ["k"]), ticks)
    seen = [r[0] for r in got.select(F.unix_micros("tick")).collect()]
    assert sorted(seen) == sorted({t for _, t in _brute(times, window, ticks)})


def test_sliding_aggregate_equals_grouping_rows(spark):
    rng = random.Random(7)
    data = [(rng.randint(0, 500), rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame(data, "u long, k string, v double").withColumn("ts", F.timestamp_micros("u"))
    window, ticks = w.TimeWindow(50, 7, 2), w.Ticks(0, 11, 60)
    aggs = {n: (n, F.col("v")) for n in ("count", "sum", "min", "max", "avg")}
    fast = w.sliding_aggregate(df, "ts", window, ticks, ["k"], aggs)
    slow = w.window_rows(df, "ts", window, ticks).groupBy("tick", "k").agg(
        F.count("v").alias("count"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg")
    )
    assert rows(fast) == rows(slow)


@pytest.mark.parametrize("width, step, every", [(4000, 1, 7), (90, 7, 11), (400, 100, 30), (60, 60, 5), (250, 40, 10), (37, 5, 50), (10, 30, 4)])
@pytest.mark.parametrize("count", [40, 0])
def test_running_aggregates_equal_copies(spark, width, step, every, count):
    """Every merge, over several keys, with rows before the first and after the last tick."""
    rng = random.Random(width)
    data = [(ms(rng.randint(-300, 700)), rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, -2.25, 4.0, 1e9])) for _ in range(300)]
    df = spark.createDataFrame(data, "ts timestamp, key string, value double")
    window, ticks = w.TimeWindow(width * 1000, step * 1000, 3000), w.Ticks(5000, every * 1000, count)
    aggs = {fn: (fn, F.col("value")) for fn in ("count", "sum", "min", "max", "avg")} | {"n": ("count", F.lit(1))}
    for keys in (["key"], []):
        got = w.sliding_aggregate(df, "ts", window, ticks, keys, aggs)
        v = F.col("value")
        plain = w.window_rows(df, "ts", window, ticks).groupBy("tick", *keys)
        plain = plain.agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.count(F.lit(1)).alias("n"))
        assert got.columns == plain.columns
        assert rows(got) == rows(plain)


def test_long_windows_do_not_copy_rows(spark):
    """Each pane is exchanged once and then in two copies, at any ratio of RANGE to EVERY."""
    df = spark.range(20_000).select(F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), (F.col("id") % 3).alias("key"), F.col("id").alias("value"))
    for width in (300, 3000):
        window, ticks = w.TimeWindow.of(f"PT{width}S", "PT1S"), w.Ticks.at(0, "PT10S", 2400)
        out = w.sliding_aggregate(df, "ts", window, ticks, ["key"], {"low": ("min", F.col("value")), "all": ("sum", F.col("value"))})
        out = out.cache()
        results = out.count()
        out.unpersist()
        plan = w.sliding_aggregate(df, "ts", window, ticks, ["key"], {"low": ("min", F.col("value")), "all": ("sum", F.col("value"))})
        plan.write.format("noop").mode("overwrite").save()
        exchanged = exchanged_rows(spark)
        assert results > 5000 and 20_000 <= exchanged <= 3 * 20_000 + results


def exchanged_rows(spark):
    """Records written by the shuffles of the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList(store.executionsCount() - 1, 1).head()
    values, total = store.executionMetrics(last.executionId()), 0
    metrics = last.metrics().iterator()
    while metrics.hasNext():
        m = metrics.next()
        if m.name() == "shuffle records written":
            got = values.get(m.accumulatorId())
            total += int(got.get().replace(",", "")) if got.isDefined() else 0
    return total


def test_durations():
    assert w.micros("PT10S") == 10_000_000
    assert w.micros("P1DT2H3M4.5S") == ((26 * 60 + 3) * 60 + 4.5) * 1_000_000
    for bad in ("P1Y", "10s", "P", "PT"):
        with pytest.raises(ValueError):
            w.micros(bad)


def test_no_ticks_for_an_empty_table(spark):
    empty = spark.createDataFrame([], "ts timestamp")
    assert w.Ticks.covering(empty, "ts", "PT1H", "PT1H").count == 0
