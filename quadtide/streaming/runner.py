"""Structured Streaming forms of the window operators, and ways to run them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from quadtide.operators.windows import HI, LO, Ticks, TimeWindow, micros, spans, unfold, window_rows
from quadtide.operators.skew import salted_join
from quadtide.session import fresh_path

# The time of the row that marks the end of a stream.
END = "9999-01-01 00:00:00"


def stream_window(df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks, delay: str) -> DataFrame:
    """Window contents of a stream, watermarked on the evaluation time.

    A row reaches ticks up to RANGE + STEP after its own time, so that much is added to the allowed
    delay: a tick is closed once rows ``delay`` older than the newest one can no longer change it.
    A mark of the end (``with_end``) moves the watermark and is in no window.
    """
    slack = window.width + window.step + micros(delay)
    rows = window_rows(df, ts, window, ticks).drop(ts)
    return rows.withWatermark("tick", f"{slack} microseconds").where(F.col("tick") < F.lit(END).cast("timestamp"))


def end_folder(spark: SparkSession, ts: str = "ts") -> str:
    """An empty folder for the mark of a stream's end."""
    path = fresh_path(spark, "end")
    spark.createDataFrame([], f"`{ts}` timestamp").write.parquet(path)
    return path


def with_end(stream: DataFrame, ends: str, ts: str = "ts") -> DataFrame:
    """The stream and, once it is written to ``ends``, a row with a time after all others.

    Its other columns are zero or empty rather than NULL, because a join lets no NULL key reach the
    watermark. Filter the stream before.
    """
    marks = stream.sparkSession.readStream.schema(f"`{ts}` timestamp").parquet(ends)

    def blank(t: T.DataType):
        value = "" if isinstance(t, T.StringType) else 0 if isinstance(t, (T.NumericType, T.BooleanType)) else None
        return F.lit(value).cast(t)

    marks = marks.select(*[(F.col(ts) if f.name == ts else blank(f.dataType)).alias(f.name) for f in stream.schema])
    return stream.unionByName(marks)


def join_streams(left: DataFrame, right: DataFrame, on: list[str], salts: int = 1) -> DataFrame:
    """Window contents of two streams at the same tick; both sides are kept only until it closes."""
    keys = ["tick", *on]
    return left.join(right, keys, "inner") if salts == 1 else salted_join(left, right, keys, salts)


def join_stream_windows(
    left: tuple[DataFrame, TimeWindow], right: tuple[DataFrame, TimeWindow], on: list[str], ticks: Ticks, delay: str, ts: str = "ts"
) -> DataFrame:
    """Inner join of the window contents of two streams at the same tick.

    State holds rows as they came, not once per tick: two rows that some tick sees together lie less than
    the reach of one window (RANGE + STEP) apart, so they are joined by that range of times, which also
    tells Spark when a row can go, and unfolded behind the join. Time is cut into buckets of four times
    that reach, so a key that never rests is spread over them; only right rows near an edge are in two.
    """
    reach = [w.width + w.step for _, w in (left, right)]
    size = 4 * max(reach)

    def side(df: DataFrame, window: TimeWindow, name: str) -> DataFrame:
        kept = df.withWatermark(ts, f"{micros(delay)} microseconds").where(F.col(ts) < F.lit(END).cast("timestamp"))
        return spans(kept, ts, window, ticks).withColumnsRenamed({c: f"__{name}_{c}" for c in (ts, LO, HI)})

    bucket = lambda name, shift: F.floor((F.unix_micros(f"__{name}_{ts}") + shift) / size)
    l = side(*left, "l").withColumn("__l_bucket", bucket("l", 0))
    r = side(*right, "r").withColumn("__r_bucket", F.explode(F.sequence(bucket("r", -reach[0]), bucket("r", reach[1]))))
    r = r.withColumnsRenamed({k: f"__r_{k}" for k in on})
    seconds = lambda n: F.expr(f"INTERVAL '{n // 1_000_000}.{n % 1_000_000:06d}' SECOND")
    lt, rt = F.col(f"__l_{ts}"), F.col(f"__r_{ts}")
    near = (rt < lt + seconds(reach[0])) & (rt > lt - seconds(reach[1])) & (F.col("__l_bucket") == F.col("__r_bucket"))
    for k in on:
        near = near & (F.col(k) == F.col(f"__r_{k}"))
    both = l.join(r, near, "inner").withColumns({LO: F.greatest(f"__l_{LO}", f"__r_{LO}"), HI: F.least(f"__l_{HI}", f"__r_{HI}")})
    hidden = [c for c in both.columns if c.startswith(("__l_", "__r_"))]
    return unfold(both.where(f"{LO} <= {HI}").drop(*hidden), ticks)


def _left_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    keys = ["tick", *on]
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn("__found", F.lit(True))
    matched = F.lit(True)
    for k in keys:
        matched = matched & (F.col(k) == F.col(f"__r_{k}"))
    return left.join(other, matched, "left_outer").drop(*[f"__r_{k}" for k in keys])


def optional_stream(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """OPTIONAL between two streams: the unmatched rows of a tick come when it closes."""
    return _left_outer(left, right, on).drop("__found")


def minus_stream(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """MINUS and NOT EXISTS between two streams."""
    out = _left_outer(left, right.select("tick", *on), on)
    return out.where(F.col("__found").isNull()).drop("__found")


def start(stream: DataFrame, path: str, checkpoint: str, name: str | None = None, available_now: bool = True) -> DataStreamWriter:
    """Append results to parquet files, exactly once, with progress kept in ``checkpoint``."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True) if available_now else writer


def drain(spark: SparkSession, stream: DataFrame, label: str, ends: str | None = None, ts: str = "ts") -> DataFrame:
    """Run a stream over all data there is and return what it has emitted.

    With ``ends`` the stream is over then: the running query reads the mark of the end behind the last
    rows, and the evaluations that were still open come out.
    """
    out, state = fresh_path(spark, f"{label}-out"), fresh_path(spark, f"{label}-state")
    query = start(stream, out, state, available_now=ends is None).start()
    if ends is None:
        query.awaitTermination()
    else:
        try:
            query.processAllAvailable()
            mark_end(spark, ends, ts)
            query.processAllAvailable()
        finally:
            query.stop()
    return spark.read.schema(stream.schema).parquet(out)


def mark_end(spark: SparkSession, ends: str, ts: str = "ts") -> None:
    spark.range(1).select(F.lit(END).cast("timestamp").alias(ts)).write.mode("append").parquet(ends)


def replay(spark: SparkSession, stream: DataFrame, folder: str, parts: list[DataFrame], label: str, ends: str, ts: str = "ts") -> DataFrame:
    """What a stream over ``folder`` emits if ``parts`` arrive there one after the other, each a
    micro-batch: rows may come in any order across parts, and those behind the watermark are dropped."""
    out, state = fresh_path(spark, f"{label}-out"), fresh_path(spark, f"{label}-state")
    for part in [*parts, None]:
        if part is None:
            mark_end(spark, ends, ts)
        else:
            part.write.mode("append").parquet(folder)
        # A run sees the files there are when it starts, so a part is never split.
        start(stream, out, state).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def to_table_files(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch as tab-separated text under its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        shown = batch.select(*[F.col(c).cast("string") for c in batch.columns])
        out = shown.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "null")
        out.csv(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
