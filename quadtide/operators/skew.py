"""Joins and distinct counts that stay balanced when one key holds a large share of the rows.

Adaptive execution splits skewed partitions of plain joins by itself. These forms do not depend on
it, so they also hold in streaming and where the skewed side feeds a broadcast-free chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, on: list[str], share: float = 0.001) -> DataFrame:
    """Keys with more than ``share`` of all rows: at most ``1 / share`` of them, whatever the data."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg((F.sum("__n") * share).alias("__limit"))
    return counts.join(F.broadcast(total), F.col("__n") > F.col("__limit")).select(*on)


def skew_join(
    left: DataFrame, right: DataFrame, on: list[str], salts: int = 32, share: float = 0.001, spread_by: list[str] | None = None
) -> DataFrame:
    """Inner join; rows of the left side's hot keys are spread over ``salts`` copies of the right rows.

    The salt is a hash of the row's own content (``spread_by``, by default all columns), so a task
    that is run again sends every row to the same place.
    """
    # The size bound of hot_keys makes this broadcast safe.
    hot = F.broadcast(hot_keys(left, on, share).withColumn("__hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by or left.columns]), F.lit(salts))
    l = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(0).cast("int"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(hot, on, "left").withColumn("__salt", F.explode(copies))
    return l.drop("__hot").join(r.drop("__hot"), [*on, "__salt"], "inner").drop("__salt")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Inner join with every left key spread over ``salts`` tasks: for streams, whose keys cannot be counted first."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    l = left.withColumn("__salt", spread)
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "__salt"], "inner").drop("__salt")


def count_distinct_by(df: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """Distinct values per key in two steps, so that a hot key is first spread over its values."""
    once = df.select(*keys, *values).distinct()
    bound = [F.col(v).isNotNull() for v in values]
    seen = bound[0]
    for b in bound[1:]:
        seen = seen & b
    return once.groupBy(*keys).agg(F.count(F.when(seen, F.lit(1))).alias(name))
