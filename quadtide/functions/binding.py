"""Binding a costly expression to a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Bind costly expressions to columns that are evaluated once per row.

    A filter on a plain projected column is pushed below the projection, with the expression copied
    to every place that uses it. A generated column is not rewritten that way.
    """
    names = {f"__let_{n}": v for n, v in values.items()}
    bound = F.inline(F.array(F.struct(*[F.col(f"__let_{n}").alias(n) for n in values])))
    kept = [c for c in df.columns if c not in values]
    return df.withColumns(names).select(*kept, bound)
