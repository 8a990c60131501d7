"""Parquet tables of one folder, with zone-less timestamps read as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = utc_times(self.spark.read.parquet(self.path(name)))
        return self._read[name]

    def stream(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(self.path(name)).schema
        # A glob, because a streaming file source takes a folder or a pattern, and a table is either.
        return utc_times(self.spark.readStream.schema(schema).parquet(self.path(name)[:-1] + "[t]"))


def utc_times(df: DataFrame) -> DataFrame:
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(naive) if naive else df


def naive_times(df: DataFrame) -> DataFrame:
    """The inverse, for results compared with engines that know no time zones."""
    zoned = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(zoned) if zoned else df
