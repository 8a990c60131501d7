"""Approximate nearest neighbours on shifted space-filling curves.

Each curve projects the vectors on a few random orthonormal directions, shifts and quantises them, and
orders them by Hilbert index. Blocks of equal numbers of rows along a curve are its range partitions,
cut at quantiles of a bounded sample. The queries of a block visit the blocks in a window around it,
are scored there on the original vectors, and the best of all windows and curves are merged.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadtide.llm.common import column, saved, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Curves:
    """``share`` of all blocks is each query's window on each of ``curves`` curves.

    Vectors without structure in d dimensions need large windows: with 64 random dimensions a share of
    0.3 on six curves gives a recall of about 0.97. Where fewer dimensions matter, a small share does.
    """

    curves: int = 6
    dims: int = 6
    bits: int = 5
    share: float = 0.3
    block: int = 1024
    sample: int = 8192
    seed: int = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell numbers below ``2**bits``."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def fit(sample: np.ndarray, conf: Curves) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, low corner, cell width) of each curve."""
    rng, out = np.random.default_rng(conf.seed), []
    d = sample.shape[1]
    for _ in range(conf.curves):
        basis = np.linalg.qr(rng.standard_normal((d, min(conf.dims, d))))[0]
        at = sample @ basis
        low, high = at.min(axis=0), at.max(axis=0)
        width = np.maximum((high - low) / ((1 << conf.bits) - 1), 1e-12)
        out.append((basis, low - rng.random(len(low)) * width, width))
    return out


def keys(x: np.ndarray, ids: np.ndarray, curve, bits: int) -> np.ndarray:
    """Order on a curve; equal cells are ordered by a hash of the id, so no cell is too large to cut."""
    basis, low, width = curve
    cells = np.clip(((x @ basis - low) / width), 0, (1 << bits) - 1)
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return hilbert(np.floor(cells), bits) << 24 | mixed.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each row the columns of its ``k`` largest scores, ties to smaller ids; ``ids`` ascend."""
    if scores.shape[1] <= k:
        return [np.argsort(-s, kind="stable") for s in scores]
    least = np.partition(scores, -k, axis=1)[:, -k]
    out = []
    for s, m in zip(scores, least):
        at = np.flatnonzero(s >= m)
        out.append(at[np.argsort(-s[at], kind="stable")[:k]])
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``vec``): vectors of doubles that are neither null nor zero and hold finite components only."""
    v = F.transform(column(vectors, vector_col), lambda x: x.cast("double"))
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), v.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _matrix(col: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    members = col[i].values
    ids = members.field("id").to_numpy(zero_copy_only=False)
    return ids, np.frombuffer(b"".join(members.field("vec").to_pylist()), np.float64).reshape(len(ids), -1)


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", conf: Curves = Curves()) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``) for the queries, rows whose id is divisible by ``every``.

    Score: inner product in double precision. Rows are known by their id: a query is not its own
    candidate, exact repeats of a row count once. Null ids and null, empty, zero or non-finite vectors
    take no part, nor do vectors of another length than the sample's most frequent one. Fewer candidates
    than ``k`` are all returned; an empty table gives none; other columns are not looked at.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, id_col, vector_col)
    # Bounded: conf.sample vectors, the smallest hashes of their ids.
    sample = [(r.id, r.vec) for r in rows.orderBy(F.xxhash64("id"), "id").limit(conf.sample).collect()]
    if not sample:
        return none
    lengths = [len(v) for _, v in sample]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    head = [(i, v) for i, v in sample if len(v) == d]
    points, point_ids = np.array([v for _, v in head]), np.array([i for i, _ in head], np.int64)
    rows = rows.where(F.size("vec") == d)
    parts = max(1, math.ceil(rows.count() / conf.block))
    curves = fit(points, conf)
    cuts = [np.quantile(np.sort(keys(points, point_ids, c, conf.bits)), np.arange(1, parts) / parts, method="nearest") for c in curves]
    reach = math.ceil(conf.share * parts / 2) if parts > 1 else 0

    def place(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            for c, curve in enumerate(curves):
                at = np.searchsorted(cuts[c], keys(x, ids, curve, conf.bits), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(at.astype(np.int32)), b.column(0), raw], ["curve", "block", "id", "vec"])

    placed = small_batches(rows, 4096).mapInArrow(place, "curve int, block int, id long, vec binary").dropDuplicates(["curve", "block", "id", "vec"])
    packed = lambda df, name: df.groupBy("curve", "block").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias(name))
    placed = saved(placed, "placed")
    data = packed(placed, "data")
    asked = packed(placed.where(F.col("id") % every == 0), "asked").select("curve", F.col("block").alias("home"), "asked")
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("home") - reach), F.least(F.lit(parts - 1), F.col("home") + reach)))
    visits = asked.select("curve", "home", "asked", window.alias("block")).join(data, ["curve", "block"])

    def score(batches):
        for t in batches:
            out = []
            for i in range(t.num_rows):
                (qi, q), (ids, x) = _matrix(t.column("asked"), i), _matrix(t.column("data"), i)
                # Rounding makes equal vectors tie whatever order the product was summed in.
                s = np.round(q @ x.T, 12)
                s[qi[:, None] == ids[None, :]] = -np.inf
                got = best(s, ids, k)
                n = np.array([len(g) for g in got])
                row, col = np.repeat(np.arange(len(qi)), n), np.concatenate(got)
                ok = np.isfinite(s[row, col])
                row, col = row[ok], col[ok]
                exact = (q[row] * x[col]).sum(axis=1)
                out.append((qi[row].astype("<i8").tobytes(), ids[col].astype("<i8").tobytes(), exact.astype("<f8").tobytes()))
            arrays = [t.column("curve"), t.column("home")] + [pa.array([o[j] for o in out], pa.binary()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["curve", "home", "q", "v", "s"])

    scored = small_batches(visits, 8).mapInArrow(score, "curve int, home int, q binary, v binary, s binary")

    def merge(batches):
        held: dict[int, dict[int, float]] = {}
        at = None

        def close():
            q, v, s = [], [], []
            for i, found in held.items():
                for j, x in sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k]:
                    q.append(i), v.append(j), s.append(x)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

        for t in batches:
            for i in range(t.num_rows):
                here = (t.column("curve")[i].as_py(), t.column("home")[i].as_py())
                if here != at and held:
                    yield close()
                    held = {}
                at = here
                q, v, s = (np.frombuffer(t.column(c)[i].as_py(), f).tolist() for c, f in (("q", "<i8"), ("v", "<i8"), ("s", "<f8")))
                for a, b, x in zip(q, v, s):
                    mine = held.setdefault(a, {})
                    mine[b] = max(x, mine.get(b, x))
        if held:
            yield close()

    runs = scored.repartition("curve", "home").sortWithinPartitions("curve", "home")
    merged = runs.mapInArrow(merge, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
