"""Every registered query, and the SQL that has to give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadtide.session import prepare
from quadtide.sources.tables import Tables, naive_times

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_FAMILIES = ("monitors", "statements", "windows", "algebra", "grouping", "forms", "paths", "uncertain", "scalars")


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under a name, with its SQL where SQL can say it."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(build(Tables(prepare(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def load_all() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
