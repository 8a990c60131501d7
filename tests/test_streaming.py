import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quadtide import vocab
from quadtide.operators import windows as w
from quadtide.sources import trig
from quadtide.streaming import runner
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def write(spark, folder, name, seconds):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), s) for s in seconds], "ts timestamp, n long")
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_late_rows_are_dropped_and_ticks_come_once(spark, tmp_path):
    source = tmp_path / "in"
    window, ticks = w.TimeWindow.of("PT10S", "PT5S", T0), w.Ticks.at(T0, "PT5S")
    write(spark, source, "a", range(0, 60, 2))

    def stream():
        return spark.readStream.schema("ts timestamp, n long").parquet(str(source))

    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        counts = runner.stream_window(stream(), "ts", window, ticks, "PT5S").groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
        runner.start(counts, out, state).start().awaitTermination()
        return {r.tick: r.n for r in spark.read.parquet(out).collect()}

    first = run()
    assert first and all(n == (5 if t > T0 + timedelta(seconds=5) else 3) for t, n in first.items())
    # A second run reads new files only: an old row is too late, newer rows close further ticks.
    write(spark, source, "b", [1, *range(60, 200, 2)])
    second = run()
    assert {t: second[t] for t in first} == first and len(second) > len(first)
    assert spark.read.parquet(out).count() == len(second)


def test_elements_from_a_growing_folder(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    prefixes = {"": "http://x/"}
    (folder / "a.trigs").write_text('GRAPH <g1> { <s1> :p 1 . << <s1> :p 1 >> :u "N(0,1)" . } <t> <%sgeneratedAtTime> "2024-01-01T00:00:00Z"^^<%sdateTime> .\n' % (vocab.PROV, vocab.XSD))
    stream = trig.stream_elements(spark, str(folder), prefixes, "http://b/")
    got = runner.drain(spark, stream.select("g", "s", "p", "o", "elem_ts"), "elements")
    assert got.count() == 3
    assert {str(r.elem_ts) for r in got.collect()} == {"2024-01-01 00:00:00"}


def test_the_end_of_a_stream_closes_every_tick(spark, tmp_path):
    window, ticks = w.TimeWindow.of("PT10S", "PT5S", T0), w.Ticks.at(T0, "PT5S")
    for seconds in (range(0, 60, 2), ()):
        source = tmp_path / f"in{len(seconds)}"
        write(spark, source, "a", seconds)
        ends = runner.end_folder(spark)
        stream = spark.readStream.schema("ts timestamp, n long").parquet(str(source))
        side = lambda: runner.stream_window(runner.with_end(stream, ends), "ts", window, ticks, "PT5S")
        counts = runner.drain(spark, side().groupBy("tick").agg(F.count(F.lit(1)).alias("n")), "counts", ends)
        batch = w.window_rows(spark.read.parquet(str(source)), "ts", window, ticks)
        assert rows(counts, "tick", "n") == rows(batch.groupBy("tick").agg(F.count(F.lit(1)).alias("n")), "tick", "n")


def test_interval_join_equals_batch_and_keeps_rows_as_they_came(spark, tmp_path):
    """Rows shuffled within the delay over several micro-batches; state is bounded by RANGE, not RANGE / EVERY."""
    rng = random.Random(8)
    ticks = w.Ticks.at(T0, "PT1S")
    wide, narrow = w.TimeWindow.of("PT60S", "PT7S", T0), w.TimeWindow.of("PT20S", "PT1S", T0)
    data = [(T0 + timedelta(seconds=s), rng.choice(["hot", "hot", "x", "y"]), n) for n, s in enumerate(rng.uniform(0, 900) for _ in range(240))]
    schema, folder, ends = "ts timestamp, key string, n long", str(tmp_path / "in"), runner.end_folder(spark)
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    pick = lambda df, r: df.where(F.col("n") % 2 == r).withColumnRenamed("n", f"n{r}")
    side = lambda r, window: (runner.with_end(pick(stream, r), ends), window)
    joined = runner.join_stream_windows(side(0, wide), side(1, narrow), ["key"], ticks, "PT30S")
    arriving = sorted(data, key=lambda r: r[0] + timedelta(seconds=rng.uniform(0, 29)))
    parts = [spark.createDataFrame(arriving[i : i + 60], schema) for i in range(0, 240, 60)]
    seen = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryProgress(self, event):
            seen.extend(op.numRowsTotal for op in event.progress.stateOperators)

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        got = runner.replay(spark, joined, folder, parts, "interval", ends).cache()
        got.count()
        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    all_rows = spark.createDataFrame(data, schema)
    batch = w.join_windows([(pick(all_rows, 0), "ts", wide), (pick(all_rows, 1), "ts", narrow)], [["key"]], w.Ticks.at(T0, "PT1S", 2000))
    assert rows(got, "tick", "key", "n0", "n1") == rows(batch, "tick", "key", "n0", "n1")
    assert got.count() > 2000
    # At most the rows of RANGE, STEP and delay on each side, in one or two buckets; 67 ticks see a row of the first.
    assert 0 < max(seen) <= 120 and seen[-1] == 0


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    window, ticks = w.TimeWindow.of("PT10S", "PT5S", T0), w.Ticks.at(T0, "PT5S")
    folder, ends, schema = str(tmp_path / "in"), runner.end_folder(spark), "ts timestamp, n long"
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = runner.with_end(spark.readStream.schema(schema).parquet(folder), ends)
    counts = runner.stream_window(stream, "ts", window, ticks, "PT5S").groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    at = lambda *seconds: spark.createDataFrame([(T0 + timedelta(seconds=s), s) for s in seconds], schema)
    # The second part is within the delay; the third comes when ticks up to 55 s are closed.
    got = runner.replay(spark, counts, folder, [at(12, 30), at(26, 31, 75), at(13, 44, 52, 70)], "late", ends)
    kept = {r.tick: r.n for r in got.collect()}
    whole = at(12, 30, 26, 31, 75, 13, 44, 52, 70)
    want = {r.tick: r.n for r in w.window_rows(whole, "ts", window, w.Ticks.at(T0, "PT5S", 50)).groupBy("tick").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Watermark of the third part: the last tick seen, 85 s, less RANGE, STEP and delay.
    closed = T0 + timedelta(seconds=65)
    lost = {T0 + timedelta(seconds=t): 1 for t in (15, 20, 45, 50, 55, 60)}
    assert all(t <= closed for t in lost)
    assert kept == {t: n - lost.get(t, 0) for t, n in want.items() if n > lost.get(t, 0)}


def test_table_files_per_batch(spark, tmp_path):
    source = tmp_path / "in"
    write(spark, source, "a", range(4))
    stream = spark.readStream.schema("ts timestamp, n long").parquet(str(source)).select("n", F.lit(None).cast("string").alias("x"))
    runner.to_table_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    text = [p.read_text() for p in (tmp_path / "out").rglob("*.csv")]
    assert text and all(t.startswith("n\tx\n") for t in text) and "null" in "".join(text)
    assert rows(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")), "n") == [("0",), ("1",), ("2",), ("3",)]
