"""RANGE/STEP windows evaluated at fixed ticks.

At tick ``t`` a window of width ``w``, step ``s`` and origin ``ref`` shows the rows whose time is in
``[u - w, u)`` with ``u = t - ((t - ref) mod s)``. The set of ticks that see a row is one contiguous
run of tick numbers, so it is computed from the row alone: no join with a tick table. Rows can stay
in that compact form ("spans") through filters, joins and aggregation and be unfolded last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LO, HI = "tick_lo", "tick_hi"

_ISO = re.compile(
    r"^P(?:(?P<days>\d+)D)?(?:T(?:(?P<hours>\d+)H)?(?:(?P<minutes>\d+)M)?(?:(?P<seconds>\d+(?:\.\d+)?)S)?)?$"
)


def micros(duration: str | timedelta) -> int:
    """Microseconds of an ISO-8601 day-time duration such as ``PT10S`` or of a timedelta."""
    if isinstance(duration, str):
        m = _ISO.match(duration)
        if not m or not any(m.groupdict().values()):
            raise ValueError(f"not a day-time duration: {duration!r}")
        duration = timedelta(**{k: float(v) for k, v in m.groupdict().items() if v})
    return duration // timedelta(microseconds=1)


def instant(at: str | datetime | int) -> int:
    """Microseconds since the epoch; text and naive datetimes are read as UTC."""
    if isinstance(at, int):
        return at
    if isinstance(at, str):
        at = datetime.fromisoformat(at)
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _floor_div(x: str, n: int) -> str:
    # Exact on longs, also below zero; a double division is not.
    return f"(({x} - pmod({x}, {n}L)) div {n}L)"


def _ceil_div(x: str, n: int) -> str:
    return f"(-{_floor_div(f'(-({x}))', n)})"


@dataclass(frozen=True)
class Ticks:
    """Evaluation instants ``start + k * every`` for k = 0 .. count-1 (unbounded if None)."""

    start: int
    every: int
    count: int | None = None

    @staticmethod
    def at(start, every: str | timedelta, count: int | None = None) -> Ticks:
        return Ticks(instant(start), micros(every), count)

    @staticmethod
    def once(at) -> Ticks:
        """One evaluation at a given time."""
        return Ticks(instant(at), 1, 1)

    @staticmethod
    def covering(df: DataFrame, ts: str, every, tail, align="P1D") -> Ticks:
        """Ticks from the first row's time, rounded down to ``align``, to ``tail`` after the last."""
        lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
        if lo is None:
            return Ticks(0, micros(every), 0)
        start = lo - lo % micros(align)
        return Ticks(start, micros(every), (hi + micros(tail) - start) // micros(every) + 1)

    def time(self, k: Column) -> Column:
        return F.timestamp_micros(F.lit(self.start) + k * F.lit(self.every))

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.count is None:
            raise ValueError("an unbounded tick series has no table")
        return spark.range(self.count).select(self.time(F.col("id")).alias("tick"))


@dataclass(frozen=True)
class TimeWindow:
    width: int
    step: int
    ref: int = 0

    @staticmethod
    def of(range_, step, ref=0) -> TimeWindow:
        width, slide = micros(range_), micros(step)
        if width <= 0 or slide <= 0:
            raise ValueError("RANGE and STEP have to be positive")
        return TimeWindow(width, slide, instant(ref))

    def upper(self, tick: Column) -> Column:
        """Exclusive upper bound at an evaluation time, as a timestamp."""
        t = F.unix_micros(tick)
        return F.timestamp_micros(t - F.pmod(t - F.lit(self.ref), F.lit(self.step)))

    def lower(self, tick: Column) -> Column:
        t = F.unix_micros(tick)
        return F.timestamp_micros(t - F.pmod(t - F.lit(self.ref), F.lit(self.step)) - F.lit(self.width))

    def max_ticks(self, ticks: Ticks) -> int:
        """Most ticks that can see one row."""
        return -(-(self.width + self.step) // ticks.every)

    def min_ticks(self, ticks: Ticks) -> int:
        """Fewest ticks that see any row, if they go on before and after it."""
        return self.width // self.step * self.step // ticks.every


def _reaching(df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks) -> DataFrame:
    """Rows of the times that the ticks cover, with their spans as if ticks had neither start nor end."""
    at, step = f"(unix_micros(`{ts}`) - {window.ref}L)", window.step
    # A tick sees the row from the first window edge after it up to the one that passes it by.
    from_edge = f"({_floor_div(at, step)} + 1) * {step}L"
    past_edge = f"({_floor_div(f'({at} + {window.width}L)', step)} + 1) * {step}L"
    shift = window.ref - ticks.start
    lo, hi = (_ceil_div(f"{edge} + {shift}L", ticks.every) for edge in (from_edge, past_edge))
    if ticks.count:
        # Said once more as a plain range of times, which reaches the scan.
        last = ticks.start + (ticks.count - 1) * ticks.every
        lower, upper = (t - (t - window.ref) % step for t in (ticks.start, last))
        df = elements_between(df, ts, lower - window.width, upper)
    return df.withColumns({LO: F.expr(lo), HI: F.expr(f"{hi} - 1L")})


def _within(df: DataFrame, ticks: Ticks) -> DataFrame:
    """Spans cut to the ticks there are."""
    hi = F.col(HI) if ticks.count is None else F.least(F.col(HI), F.lit(ticks.count - 1))
    return df.withColumns({LO: F.greatest(F.col(LO), F.lit(0)), HI: hi}).where(f"{LO} <= {HI}")


def spans(df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks) -> DataFrame:
    """Add the first and last tick number that see each row; rows no tick sees are dropped."""
    return _within(_reaching(df, ts, window, ticks), ticks)


def unfold(df: DataFrame, ticks: Ticks) -> DataFrame:
    """One row per tick of the span, with the evaluation time in ``tick``."""
    wide = df.withColumn("__k", F.explode(F.sequence(LO, HI)))
    return wide.withColumn("tick", ticks.time(F.col("__k"))).drop("__k", LO, HI)


def window_rows(df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks) -> DataFrame:
    """Window contents at every tick. Filter and project before: a row appears once per tick."""
    return unfold(spans(df, ts, window, ticks), ticks)


def distinct_spans(df: DataFrame, key: list[str]) -> DataFrame:
    """Collapse equal rows so that each tick sees a key once.

    Equal spans fall together in the map-side distinct; what is left per key is at most one row per
    tick, and later spans are trimmed to start after the one before.
    """
    once = df.select(*key, LO, HI).distinct()
    before = F.lag(HI).over(W.partitionBy(*key).orderBy(LO, HI))
    trimmed = once.withColumn(LO, F.greatest(F.col(LO), F.coalesce(before + 1, F.col(LO))))
    return trimmed.where(F.col(LO) <= F.col(HI))


def join_many(parts: list[DataFrame], on: list[str], longest: int) -> DataFrame:
    """Join rows of several windows that some tick sees together; the result carries the shared span.

    ``longest`` is the largest ``max_ticks`` of the windows. Spans are cut at multiples of it, so a row is
    copied at most twice instead of once per tick, and a hot key is spread over time. All inputs are cut
    alike and meet on key and bucket, so each is exchanged once whatever their number; of the buckets
    that hold a combination the one with its latest start keeps it.
    """
    size, out = max(1, longest), None
    for i, part in enumerate(parts):
        buckets = F.expr(f"explode(sequence({_floor_div(LO, size)}, {_floor_div(HI, size)}))")
        cut = part.withColumn("__bucket", buckets).withColumnsRenamed({LO: f"__lo_{i}", HI: f"__hi_{i}"})
        if out is None:
            out = cut
        else:
            lo, hi = (", ".join(f"__{side}_{j}" for j in range(i + 1)) for side in ("lo", "hi"))
            out = out.join(cut, [*on, "__bucket"]).where(f"greatest({lo}) <= least({hi})")
    ends = {c: [f"__{c}_{i}" for i in range(len(parts))] for c in ("lo", "hi")}
    if len(parts) > 1:
        lo, hi = F.greatest(*ends["lo"]), F.least(*ends["hi"])
    else:
        lo, hi = F.col("__lo_0"), F.col("__hi_0")
    out = out.withColumns({LO: lo, HI: hi}).where(f"__bucket = {_floor_div(LO, size)}")
    return out.drop("__bucket", *ends["lo"], *ends["hi"])


def join_spans(left: DataFrame, right: DataFrame, on: list[str], longest: int) -> DataFrame:
    """``join_many`` of two."""
    return join_many([left, right], on, longest)


def placed(df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks) -> DataFrame:
    """Spans of a table; one that has them already stays as it is."""
    return df if LO in df.columns else spans(df, ts, window, ticks).drop(ts)


def time_columns(df: DataFrame, ts: str = "ts") -> list[str]:
    return [LO, HI] if LO in df.columns else [ts]


def join_windows(parts: list[tuple[DataFrame, str, TimeWindow]], on: list[list[str]], ticks: Ticks) -> DataFrame:
    """Inner join of several window contents at the same tick; ``on[i]`` joins part i+1. Parts that follow
    each other on the same keys are joined at once."""
    longest = max(w.max_ticks(ticks) for _, _, w in parts)
    shown = [placed(*part, ticks) for part in parts]
    out, i = shown[0], 0
    while i < len(on):
        n = i + 1
        while n < len(on) and on[n] == on[i]:
            n += 1
        out = join_many([out, *shown[i + 1 : n + 1]], on[i], longest)
        i = n
    return unfold(out, ticks)


# Aggregates that can be merged from partial results: name -> (how each partial is made and merged, result).
_MERGE = {
    "count": ([(F.count, "sum")], lambda p: F.coalesce(p[0], F.lit(0).cast("long"))),
    "sum": ([(F.sum, "sum")], lambda p: p[0]),
    "min": ([(F.min, "min")], lambda p: p[0]),
    "max": ([(F.max, "max")], lambda p: p[0]),
    "avg": ([(F.sum, "sum"), (F.count, "sum")], lambda p: F.try_divide(p[0], p[1])),
}
# The same merge as an aggregate and for two values, of which either may be missing.
_OVER = {"sum": F.sum, "min": F.min, "max": F.max}
_TWO = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}


def _partials(aggs: dict[str, tuple[str, Column]]) -> tuple[list[tuple[str, Column, str]], list]:
    """(name, aggregate, merge) of all partial results, and the final columns as functions of them."""
    parts, final = [("__rows", F.count(F.lit(1)), "sum")], []
    for name, (fn, column) in aggs.items():
        made, result = _MERGE[fn]
        own = [f"__{name}_{i}" for i in range(len(made))]
        parts += [(n, make(column), how) for n, (make, how) in zip(own, made)]
        final.append((name, own, result))
    return parts, [lambda get, n=name, o=own, r=result: r([get(x) for x in o]).alias(n) for name, own, result in final]


def sliding_aggregate(
    df: DataFrame, ts: str, window: TimeWindow, ticks: Ticks, keys: list[str],
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Group by tick and keys, from partial results of rows that are seen by the same ticks.

    All rows between two neighbouring window edges have the same span, so they are reduced to one row
    per key first. Ticks are cut into blocks as long as the shortest span: then every span reaches the
    start or the end of each block it touches, and what a tick sees are the spans that have started since
    the block's start and those that have not ended yet. Both are running aggregates in a block, for any
    merge and without subtraction, so a row is copied to two or three blocks and not to its ticks.

    Rows with spans already, and windows that hardly overlap, are copied to the ticks instead.
    """
    parts, final = _partials(aggs)
    size = window.min_ticks(ticks)
    if LO in df.columns or size < 3:
        seen = df if LO in df.columns else spans(df, ts, window, ticks)
        panes = seen.groupBy(*keys, LO, HI).agg(*[c.alias(n) for n, c, _ in parts])
        merged = {n: _OVER[how](n) for n, _, how in parts}
        return unfold(panes, ticks).groupBy("tick", *keys).agg(*[f(merged.get) for f in final])
    panes = _reaching(df, ts, window, ticks).groupBy(*keys, LO, HI).agg(*[c.alias(n) for n, c, _ in parts])
    block = F.explode(F.sequence(F.floor(F.col(LO) / size), F.floor(F.col(HI) / size)))
    # Dealt by key and block once; all that follows keeps to that.
    dealt = panes.withColumn("__block", block).repartition(*[F.col(k) for k in keys], F.col("__block"))
    first, past = F.col("__block") * size, (F.col("__block") + 1) * size
    begins = F.col(LO) > first
    change = F.when(begins, F.col(LO)).otherwise(F.least(F.col(HI) + 1, past))
    sides = [_OVER[how](F.when(side, F.col(n))).alias(f"{n}_{x}") for n, _, how in parts for x, side in (("in", begins), ("out", ~begins))]
    steps = dealt.withColumn("__at", change).groupBy(*keys, "__block", "__at").agg(*sides)
    up = W.partitionBy(*keys, "__block").orderBy("__at")
    down = W.partitionBy(*keys, "__block").orderBy(F.desc("__at"))
    begun, to_end = up.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, 0)
    later = down.rowsBetween(W.unboundedPreceding, -1)
    after, before = [], []
    for n, _, how in parts:
        merge = _OVER[how]
        after.append(_TWO[how](merge(f"{n}_in").over(begun), merge(f"{n}_out").over(later)).alias(n))
        before.append(merge(f"{n}_out").over(to_end).alias(n))
    upto = F.coalesce(F.lead("__at").over(up), past) - 1
    head = F.when(F.row_number().over(up) == 1, F.struct(first.alias(LO), (F.col("__at") - 1).alias(HI), *before))
    runs = steps.select(*keys, F.array(F.struct(F.col("__at").alias(LO), upto.alias(HI), *after), head).alias("__runs"))
    runs = runs.select(*keys, F.explode("__runs").alias("__run")).select(*keys, "__run.*").where("__rows > 0")
    return unfold(_within(runs, ticks), ticks).select("tick", *keys, *[f(F.col) for f in final])


def everywhere(static: DataFrame, ticks: Ticks) -> DataFrame:
    """Background rows in span form: every tick sees them."""
    return static.withColumns({LO: F.lit(0).cast("long"), HI: F.lit(ticks.count - 1).cast("long")}).where(f"{LO} <= {HI}")


def at_ticks(static: DataFrame, ticks: Ticks) -> DataFrame:
    """Background rows seen at every tick."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ticks.count - 1).cast("long")))
    return static.withColumn("__k", k).withColumn("tick", ticks.time(F.col("__k"))).drop("__k")


def elements_between(df: DataFrame, ts: str, lower, upper) -> DataFrame:
    """Rows with lower <= time < upper."""
    lo, hi = (F.timestamp_micros(F.lit(instant(x))) for x in (lower, upper))
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))
