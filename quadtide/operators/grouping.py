"""Grouping, aggregates and solution modifiers with SPARQL's conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.session import shared_dir


def count_all() -> Column:
    return F.count(F.lit(1))


def count(x: Column, distinct: bool = False) -> Column:
    return F.count_distinct(x) if distinct else F.count(x)


def count_distinct_rows(columns: list[str]) -> Column:
    """COUNT(DISTINCT *): unbound values count as values."""
    return F.count_distinct(F.struct(*columns))


def sum_(x: Column, distinct: bool = False) -> Column:
    """SUM; 0 for an empty group."""
    return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0).cast("double"))


def avg(x: Column, distinct: bool = False) -> Column:
    """AVG; 0 for an empty group."""
    mean = F.call_function("avg", x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
    return F.coalesce(mean, F.lit(0).cast("double"))


def sum_terms(term: Column) -> Column:
    """SUM over term text: unbound if any bound term is no number."""
    bad = F.count(F.when(term.isNotNull() & terms.num(term).isNull(), 1))
    return F.when(bad == 0, sum_(terms.num(term)))


def min_term(term: Column) -> Column:
    return F.min(F.when(term.isNotNull(), terms.order_key(term)))["text"]


def max_term(term: Column) -> Column:
    return F.max(F.when(term.isNotNull(), terms.order_key(term)))["text"]


def sample(x: Column) -> Column:
    """SAMPLE: some bound value, the same on every run."""
    return F.min(x)


def group_concat(x: Column, separator: str = " ", order_by: Column | None = None, distinct: bool = False) -> Column:
    """GROUP_CONCAT; the result is one string per group, so a group has to fit in one."""
    if distinct:
        return F.array_join(F.array_sort(F.collect_set(x)), separator)
    key = x if order_by is None else order_by
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("k"), x.alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)



def variance(x: Column, population: bool = False) -> Column:
    return F.var_pop(x) if population else F.var_samp(x)


def stdev(x: Column, population: bool = False) -> Column:
    return F.stddev_pop(x) if population else F.stddev_samp(x)


def grouped(df: DataFrame, keys: list, aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY over columns, expressions, or ``(name, expression)``; HAVING sees the results."""
    cols = [k[1].alias(k[0]) if isinstance(k, tuple) else k for k in keys]
    out = df.groupBy(*cols).agg(*[c.alias(n) for n, c in aggs.items()])
    return out if having is None else out.where(having)


def distinct_then(df: DataFrame, keys: list[str], value: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the DISTINCT values of one column, for functions without a DISTINCT form."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def order_by(df: DataFrame, *keys: Column) -> DataFrame:
    """ORDER BY over term columns or typed columns; unbound first, as ``asc_nulls_first``."""
    return df.orderBy(*keys)


def order_terms(df: DataFrame, *columns: tuple[str, bool]) -> DataFrame:
    """ORDER BY term columns: (name, ascending)."""
    keys = []
    for name, up in columns:
        k = terms.order_key(F.col(name))
        keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
    return df.orderBy(*keys)


def numbered(df: DataFrame, *keys: Column, name: str = "position") -> DataFrame:
    """Rows with their place in the order, from 1.

    Tasks hold ranges of the order; a place is the place in the task and the rows of the tasks before,
    of which there is one number per task.
    """
    shared_dir(df.sparkSession)
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    # The number of the task is in the upper bits, the place in the task in the lower 33.
    task = F.shiftright("__id", 33)
    sizes = laid.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__task", before.alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.withColumn("__task", task).join(F.broadcast(starts), "__task").select(*df.columns, place.alias(name))


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)


def top(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """ORDER BY with LIMIT: each task keeps its best k."""
    return df.orderBy(*keys).limit(k)


def top_per(df: DataFrame, groups: list[str], k: int, *keys: Column) -> DataFrame:
    """The first k rows of every group; the limit is applied in each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*keys))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def reduced(df: DataFrame) -> DataFrame:
    """REDUCED: duplicates may go, and here they do."""
    return df.distinct()
