"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.session import fresh_path

# Workers need not have the package: functions of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Words a task remembers the hash of before it starts over.
WORD_CACHE = 1 << 20


#: Spark's setting to remove the shuffle files of a query that is done.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written to the session's shared folder and read back: cuts lineage, survives a lost executor. The
    shuffle files behind it have served then and go, rather than stay until the driver collects garbage."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """Bound the texts one Arrow batch holds; a session setting, as Spark has no other place for it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """A column by its exact name, with whatever characters."""
    return df["`" + name.replace("`", "``") + "`"]


def word_count(text):
    """Number of words, null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_memo(key, make):
    """What ``make`` builds, kept as long as the Python worker; later tasks of the worker find it again."""
    kept = sys.__dict__.setdefault("_quadtide_memo", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Shingler:
    """The set of hashed word shingles of a text, as a sorted array of unsigned 64-bit numbers.

    Words are separated by ASCII white space, A-Z count as a-z. A text with fewer than ``k`` words has
    its whole word sequence as its only shingle; a text without words has the empty set.
    """

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.array([known[w] for w in words], np.uint64)
        k = min(self.k, len(codes))
        h = np.full(len(codes) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - k + 1 + i]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)
