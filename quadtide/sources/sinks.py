"""Text and table outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadtide.operators.quads import KEY
from quadtide.vocab import DEFAULT_GRAPH


def statement_line() -> Column:
    """One line per statement; readable again one line at a time."""
    plain = F.concat_ws(" ", "s", "p", "o")
    named = F.concat(F.lit("GRAPH "), F.col("g"), F.lit(" { "), plain, F.lit(" . }"))
    return F.when(F.col("g") == DEFAULT_GRAPH, F.concat(plain, F.lit(" ."))).otherwise(named)


def write_statements(quads: DataFrame, path: str) -> None:
    quads.select(statement_line().alias("value")).write.mode("errorifexists").text(path)


def write_table(results: DataFrame, path: str) -> None:
    """Tab-separated solutions with a header; unbound is ``null``."""
    shown = results.select(*[F.col(c).cast("string") for c in results.columns])
    out = shown.write.mode("errorifexists").option("sep", "\t").option("header", True)
    out.option("nullValue", "null").option("emptyValue", "").csv(path)


def table_lines(results: DataFrame) -> DataFrame:
    """The same rows as plain text lines, without quoting."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in results.columns]
    return results.select(F.concat_ws("\t", *cells).alias("value"))


def execution_summary(evaluations: DataFrame, warm_up: int, measured: int, run: dict[str, object] | None = None) -> DataFrame:
    """Average, minimum and maximum duration and average result count of the measured evaluations.

    ``evaluations``: number (from 1), duration, results. Also keeps the list of durations in order.
    """
    n = F.col("number")
    used = evaluations.where((n > warm_up) & (n <= warm_up + measured))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "duration"))), lambda x: x["duration"].cast("string"))
    out = used.agg(
        F.avg("duration").alias("duration_avg"), F.min("duration").alias("duration_min"),
        F.max("duration").alias("duration_max"), F.avg("results").alias("results_avg"),
        F.count(F.lit(1)).alias("evaluations"), F.array_join(listed, ", ").alias("durations"),
    )
    return out.withColumns({k: F.lit(v) for k, v in (run or {}).items()})


def elements_of_graphs(constructed: DataFrame) -> DataFrame:
    """One stream element per named graph: its statements and the default-graph ones about it."""
    inner = constructed.where(F.col("g") != DEFAULT_GRAPH).withColumn("elem_id", F.col("g"))
    graphs = inner.select(F.col("g").alias("s")).distinct()
    outer = constructed.where(F.col("g") == DEFAULT_GRAPH).join(graphs, "s", "left_semi").withColumn("elem_id", F.col("s"))
    cols = ["elem_id", *KEY, *[c for c in constructed.columns if c not in KEY]]
    return inner.select(*cols).unionByName(outer.select(*cols))
