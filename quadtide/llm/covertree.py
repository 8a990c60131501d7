"""Exact top-k by inner product with a dual traversal of cover trees.

The upper levels of the trees are shared: cells around pivots chosen far apart in a bounded sample, cut
into blocks of bounded size, each with its covering ball. A pair of a query block and a data block can
reach at most <c,p> + r|p| + s|c| + r s, with the balls' centres c, p and radii r, s. Every query
block first visits the data block with the largest bound; the worst kth score of the group it finds
there prunes the pairs that remain. Inside a pair both blocks are cover trees, traversed together in
the same way down to their leaves.
"""

from __future__ import annotations

import heapq
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
class Trees:
    """At most ``pivots`` cells from a sample of ``sample`` vectors; blocks of about ``block`` rows;
    leaves of ``leaf`` rows; inner nodes of at most ``fan`` children."""

    pivots: int = 512
    sample: int = 4096
    block: int = 2048
    asked: int = 512
    leaf: int = 64
    fan: int = 8


def far_apart(x: np.ndarray, n: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows chosen each the farthest from those before, until ``n`` or all others lie within ``stop``;
    and the number of the nearest chosen one for every row."""
    chosen, near = [0], np.zeros(len(x), np.int64)
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n:
        far = int(away.argmax())
        if away[far] <= stop * stop:
            break
        d = ((x - x[far]) ** 2).sum(axis=1)
        closer = d < away
        near[closer], away[closer] = len(chosen), d[closer]
        chosen.append(far)
    return np.array(chosen), near


class Node:
    """Rows of a block under one centre: covered by ``radius``, children within half of it where the
    fan allows, their centres farther apart than that."""

    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, conf: Trees):
        part = x[rows]
        self.rows, self.centre = rows, part.mean(axis=0)
        self.radius = math.sqrt(((part - self.centre) ** 2).sum(axis=1).max())
        self.norm = math.sqrt((self.centre**2).sum())
        self.children: list[Node] = []
        if len(rows) > conf.leaf and self.radius > 0:
            chosen, near = far_apart(part, conf.fan, self.radius / 2)
            if len(chosen) > 1:
                self.children = [Node(x, rows[near == k], conf) for k in range(len(chosen))]


def bound(a: Node, b: Node) -> float:
    """No inner product between rows of the two is larger; the factor covers rounding."""
    top = a.centre @ b.centre + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return top + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-9


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return self.scores[rows, -1].min()

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        live = (scores >= self.scores[rows, -1][:, None]).any(axis=1)
        for r, s in zip(rows[live], scores[live]):
            ok = np.flatnonzero((s >= self.scores[r, -1]) & (s > -np.inf))
            if len(ok):
                both, names = np.concatenate([self.scores[r], s[ok]]), np.concatenate([self.ids[r], ids[ok]])
                order = np.lexsort((names, -both))[: self.k]
                self.scores[r], self.ids[r] = both[order], names[order]


def traverse(q: Node, p: Node, qx, qi, px, pi, best: Best) -> None:
    """Visit pairs of nodes, most promising first, unless they cannot beat the group's worst kth score."""
    queue, n = [(-bound(q, p), 0, q, p)], 1
    while queue:
        top, _, a, b = heapq.heappop(queue)
        if -top < best.worst(a.rows):
            continue
        if not a.children and not b.children:
            s = qx[a.rows] @ px[b.rows].T
            s[qi[a.rows][:, None] == pi[b.rows][None, :]] = -np.inf
            best.offer(a.rows, s, pi[b.rows])
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        for x, y in [(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]:
            heapq.heappush(queue, (-bound(x, y), n, x, y))
            n += 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(``id``, ``vec``): floor(scale * x) of every component, for vectors with finite components only."""
    v = F.transform(column(vectors, vector_col), lambda x: x.cast("double"))
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vec"))


def _block(col: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    members = col[i].values
    ids = members.field("id").to_numpy(zero_copy_only=False)
    return ids, np.frombuffer(b"".join(members.field("vec").to_pylist()), np.float64).reshape(len(ids), -1)


def search(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, conf: Trees = Trees()) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``) for the queries, rows whose id is divisible by ``every``.

    Score: inner product of the vectors of floor(scale * x), a whole number (exact below 2**53). Ties go
    to the smaller id. Rows are known by their id: a query is not its own candidate, exact repeats of a
    row count once. Null ids and null, empty or non-finite vectors take no part, nor do vectors of
    another length than the sample's most frequent one. Fewer candidates than ``k`` are all returned; an
    empty table gives none; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    # Bounded: conf.sample vectors, the smallest hashes of their ids.
    sample = [r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(conf.sample).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = [len(v) for v in sample]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    points = np.array([v for v in sample if len(v) == d])
    rows = rows.where(F.size("vec") == d)
    pivots = points[far_apart(points, max(1, min(conf.pivots, rows.count() // conf.block)))[0]]

    def place(batches):
        half = (pivots**2).sum(axis=1) / 2
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            cell = (x @ pivots.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cell, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "cell", "vec"])

    placed = saved(small_batches(rows, 4096).mapInArrow(place, "id long, cell int, vec binary").dropDuplicates(["id", "vec"]), "placed")

    def packed(part: DataFrame, size: int, name: str) -> DataFrame:
        """One row per block: a cell, or a hashed part of a large one."""
        parts = part.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
        dealt = part.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        return dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias(name))

    def ball(name: str):
        def run(batches):
            for t in batches:
                out = []
                for i in range(t.num_rows):
                    _, x = _block(t.column(name), i)
                    c = x.mean(axis=0)
                    out.append((c.tolist(), math.sqrt(((x - c) ** 2).sum(axis=1).max()), math.sqrt((c**2).sum())))
                arrays = [t.column("cell"), t.column("part")] + [pa.array(col, kind) for col, kind in zip(zip(*out), (pa.list_(pa.float64()), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "part", "centre", "radius", "norm"])

        return run

    shape = "cell int, part long, centre array<double>, radius double, norm double"
    data, asked = saved(packed(placed, conf.block, "data"), "blocks"), saved(packed(placed.where(F.col("id") % every == 0), conf.asked, "asked"), "asked")
    small_batches(rows, 8)
    a = saved(asked.mapInArrow(ball("asked"), shape), "balls").select(*(F.col(c).alias(f"q{c}") for c in ("cell", "part", "centre", "radius", "norm")))
    b = saved(data.mapInArrow(ball("data"), shape), "balls")
    # Blocks of the stated query set against blocks of all rows: one small row for thousands of pairs.
    dot = F.aggregate(F.zip_with("qcentre", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = (F.col("qnorm") + F.col("qradius")) * (F.col("norm") + F.col("radius"))
    top = dot + F.col("qradius") * F.col("norm") + F.col("radius") * F.col("qnorm") + F.col("qradius") * F.col("radius") + reach * 1e-9 + 1e-9
    pairs = a.crossJoin(b).select("qcell", "qpart", "cell", "part", top.alias("top"))
    pairs = saved(pairs.withColumn("turn", F.row_number().over(Window.partitionBy("qcell", "qpart").orderBy(F.desc("top"), "cell", "part"))), "pairs")

    def visit(batches):
        for t in batches:
            out = []
            for i in range(t.num_rows):
                (qi, qx), (pi, px) = _block(t.column("asked"), i), _block(t.column("data"), i)
                best = Best(len(qi), k)
                traverse(Node(qx, np.arange(len(qi)), conf), Node(px, np.arange(len(pi)), conf), qx, qi, px, pi, best)
                row, col = np.nonzero(best.scores > -np.inf)
                out.append((qi[row], best.ids[row, col], best.scores[row, col].astype(np.int64), np.array([best.scores[:, -1].min()])))
            cols = [pa.array([o[j].tolist() for o in out], pa.list_(pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([t.column("qcell"), t.column("qpart"), *cols, pa.array([o[3][0] for o in out], pa.float64())], ["qcell", "qpart", "q", "v", "s", "worst"])

    def visited(some: DataFrame) -> DataFrame:
        asking = asked.select(F.col("cell").alias("qcell"), F.col("part").alias("qpart"), "asked")
        both = some.join(asking, ["qcell", "qpart"]).join(data, ["cell", "part"]).select("qcell", "qpart", "asked", "data")
        return saved(small_batches(both, 4).mapInArrow(visit, "qcell int, qpart long, q array<long>, v array<long>, s array<long>, worst double"), "visited")

    first = visited(pairs.where("turn = 1"))
    rest = pairs.where("turn > 1").join(first.select("qcell", "qpart", "worst"), ["qcell", "qpart"]).where("top >= worst")
    found = first.unionByName(visited(rest)).select(F.explode(F.arrays_zip("q", "v", "s")).alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select(F.col("x.q").alias("query_id"), F.col("x.v").alias("vec_id"), F.col("x.s").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
