"""Hard negatives by Kronecker-packed inner products.

Components are turned into integers. Those of several candidates are biased to be non-negative and put
into separate fields of one wide integer, so one multiplication with an anchor's component serves all of
them: sum_d a_d * (c_1d + c_2d * 2^w + ...) holds every candidate's biased score in a field of its own,
as no sum reaches 2^w. Taking the biases off again leaves the exact scores. Fields are as wide as the
values at hand need; as many as fit make a machine word, and beyond 64 bits the words are Python integers.

The anchors are a stated query set that meets all rows in a grid: both sides are dealt into blocks of
bounded size, and a cell of the grid holds one block of each. The first pass pairs blocks of one label and
gives the positives, the second pairs all blocks and gives what lies in the positives' score bands.
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

from quadtide.llm.common import column, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Mining:
    """Anchors are rows whose id is divisible by ``every``. Each has its first ``positives`` rows of the
    same label, and for each of those the first ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` of ``of`` parts of the positive's. Components are multiplied by ``scale``
    and rounded down. About ``block`` rows and ``asked`` anchors make a cell; ``strip`` of both are
    multiplied at a time."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    of: int = 100
    scale: int = 256
    block: int = 8192
    asked: int = 8192
    strip: tuple[int, int] = (64, 2048)


def packed(c: np.ndarray, bias: int, width: int, fields: int) -> np.ndarray:
    """Words (dimension, word): row ``word * fields + j`` of ``c`` lies in field ``j``, biased."""
    whole = np.zeros((-len(c) % fields + len(c), c.shape[1]), c.dtype)
    whole[: len(c)] = c + bias
    whole = whole.reshape(-1, fields, c.shape[1])
    kind = np.uint64 if width * fields <= 64 else object
    words = np.zeros((whole.shape[0], c.shape[1]), kind)
    for j in range(fields):
        words += whole[:, j].astype(kind) << (np.uint64(width * j) if kind is np.uint64 else width * j)
    return np.ascontiguousarray(words.T)


def scores(a: np.ndarray, c: np.ndarray, strip: tuple[int, int] = (64, 2048)) -> np.ndarray:
    """All inner products of the rows of two integer matrices (int64, or object for any size), exact."""
    n, m, d = len(a), len(c), a.shape[1]
    if not n or not m or not d:
        return np.zeros((n, m), np.int64)
    ba, bc = (max(0, -int(x.min())) for x in (a, c))
    most = d * (int(a.max()) + ba) * (int(c.max()) + bc)
    width = max(1, most.bit_length())
    fields = max(1, 64 // width) if width <= 64 else 4
    kind = np.uint64 if width <= 64 else object
    words = packed(c, bc, width, fields)
    plain = np.int64 if kind is np.uint64 and d * max(ba, int(a.max())) * max(bc, int(c.max())) < 1 << 62 else object
    shift = [np.uint64(width * j) if kind is np.uint64 else width * j for j in range(fields)]
    mask = np.uint64((1 << width) - 1) if kind is np.uint64 else (1 << width) - 1
    a1, sa, sc = (a + ba).astype(kind), a.astype(plain).sum(axis=1), c.astype(plain).sum(axis=1)
    out = np.zeros((n, words.shape[1] * fields), plain)
    for i in range(0, n, strip[0]):
        for k in range(0, words.shape[1], strip[1]):
            part = a1[i : i + strip[0], 0, None] * words[0, k : k + strip[1]]
            for j in range(1, d):
                part += a1[i : i + strip[0], j, None] * words[j, k : k + strip[1]]
            for f in range(fields):
                out[i : i + strip[0], k * fields + f : (k + part.shape[1]) * fields : fields] = ((part >> shift[f]) & mask).astype(plain)
    # (a + A)(c + C) summed is ac + C sum(a) + A sum(c) + d A C.
    return out[:, :m] - bc * sa[:, None] - ba * sc[None, :] - d * ba * bc


def integers(vectors: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for each length among the vectors; any size of number stays exact."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(float(scale) * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts, out = np.concatenate([[0], np.cumsum(sizes)[:-1]]), []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)[None, :]]
        small = not x.size or np.abs(x).max() < 1 << 31
        out.append((rows, x.astype(np.int64) if small else np.array([[int(v) for v in r] for r in x.tolist()], object)))
    return out


def _array(t: pa.Table, name: str):
    got = t.column(name).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def meetings(left: pa.Table, right: pa.Table, conf: Mining):
    """(anchor rows, candidate rows by id, scores) for the vectors of one length, a strip of anchors at a time."""
    theirs = {m.shape[1]: (r, m) for r, m in integers(_array(right, "vector"), conf.scale)}
    names = _array(right, "id").to_numpy()
    for rows, a in integers(_array(left, "vector"), conf.scale):
        if a.shape[1] not in theirs:
            continue
        cols, c = theirs[a.shape[1]]
        order = np.argsort(names[cols], kind="stable")
        cols, c = cols[order], c[order]
        for i in range(0, len(rows), conf.strip[0]):
            yield rows[i : i + conf.strip[0]], cols, scores(a[i : i + conf.strip[0]], c, conf.strip)


def first(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, ties by place."""
    if len(s) > 4 * k:
        worst = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= worst)
        return near[np.argsort(-s[near], kind="stable")[:k]]
    return np.argsort(-s, kind="stable")[:k]


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields})


def _held(score) -> int:
    """Scores outside the range of a long are reported as its ends."""
    return max(LONG[0], min(LONG[1], int(score)))


def positives(left: pa.Table, right: pa.Table, conf: Mining) -> pa.Table:
    """The best rows of a cell of one label for each anchor."""
    out = {"anchor": [], "positive": [], "score": []}
    ids, theirs = _array(left, "id").to_numpy(), _array(right, "id").to_numpy()
    for rows, cols, s in meetings(left, right, conf):
        for r, line in zip(rows, s):
            ok = np.flatnonzero(theirs[cols] != ids[r])
            best = ok[first(line[ok], conf.positives)]
            out["anchor"] += [ids[r]] * len(best)
            out["positive"] += theirs[cols[best]].tolist()
            out["score"] += [_held(x) for x in line[best]]
    return _table(out, POSITIVE)


def negatives(left: pa.Table, right: pa.Table, conf: Mining) -> pa.Table:
    """The best rows of a cell in the score band of each positive of each anchor."""
    out = {"anchor": [], "positive": [], "pscore": [], "negative": [], "score": [], "place": []}
    ids, theirs = _array(left, "id").to_numpy(), _array(right, "id").to_numpy()
    codes = pa.chunked_array([_array(left, "label"), _array(right, "label")]).combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    mine, other, found = codes[: len(ids)], codes[len(ids) :], _array(left, "found").to_pylist()
    for rows, cols, s in meetings(left, right, conf):
        for r, line in zip(rows, s):
            bands = [(p["positive"], p["score"], p["place"], -(-conf.low * p["score"] // conf.of), conf.high * p["score"] // conf.of) for p in found[r]]
            least, most = min(b[3] for b in bands), max(b[4] for b in bands)
            near = np.flatnonzero((line >= least) & (line <= most))
            near = near[(other[cols[near]] != mine[r]) & (theirs[cols[near]] != ids[r])]
            near = near[np.argsort(-line[near], kind="stable")]
            falling = -line[near]
            for positive, score, place, lo, hi in bands:
                start, end = np.searchsorted(falling, -hi, "left"), np.searchsorted(falling, -lo, "right")
                best = near[start : min(end, start + conf.negatives)]
                out["anchor"] += [ids[r]] * len(best)
                out["positive"] += [positive] * len(best)
                out["pscore"] += [score] * len(best)
                out["place"] += [place] * len(best)
                out["negative"] += theirs[cols[best]].tolist()
                out["score"] += [_held(x) for x in line[best]]
    return _table(out, NEGATIVE)


POSITIVE = "anchor long, positive long, score long"
NEGATIVE = "anchor long, positive long, pscore long, negative long, score long, place int"


def cells(anchors: DataFrame, rows: DataFrame, key: list[str], asked, block, work, schema: str, conf: Mining) -> DataFrame:
    """``work`` on every cell of the grid of ``asked`` blocks of anchors and ``block`` blocks of rows
    within ``key``; ``row`` deals both evenly, whatever their ids or labels repeat."""
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = anchors.withColumns({"one": F.pmod("row", asked), "to": block}).withColumn("two", spread(F.col("to"))).drop("to")
    right = rows.withColumns({"two": F.pmod("row", block), "to": asked}).withColumn("one", spread(F.col("to"))).drop("to")
    by = [*key, "one", "two"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: work(a, b, conf), schema)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", conf: Mining = Mining()
) -> DataFrame:
    """Rows (``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    Rows without id, label or vector, or with a null or non-finite component, take no part. Higher scores
    come first, ties by smaller id. A row that repeats an id is a candidate of its own, but never of an
    anchor with that id; of anchors with one id the one with the smallest label and vector is taken, and a
    positive that repeats has its negatives once for each place it takes. Vectors of another length than
    the anchor's are no candidates. Scores are exact; one outside the range of a long is cut to its end.
    Other columns are not looked at; an empty table gives no rows.
    """
    label, vector = column(vectors, label_col), column(vectors, vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    part = vectors.select(column(vectors, id_col).cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
    part = part.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    # The number is written with the row, so a task that runs again deals it as before.
    part = saved(part.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = part.where(F.pmod("id", F.lit(conf.every)) == 0)
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "vector", "row")).alias("a")).select("id", "a.*")
    anchors = saved(anchors, "anchors")
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("long")

    # Rows of one label that fill several blocks; there are at most rows / block such labels.
    large = lambda df, n, size: df.groupBy("label").agg(blocks(F.count("*"), size).alias(n)).where(F.col(n) > 1)
    many = large(part, "pb", conf.block).join(large(anchors, "pa", conf.asked), "label", "full_outer")
    many = saved(many.select(F.col("label").alias("l"), F.coalesce("pa", F.lit(1)).alias("pa"), F.coalesce("pb", F.lit(1)).alias("pb")), "labels")
    dealt = lambda df: df.join(many, df["label"] == many["l"], "left").drop("l").na.fill(1, ["pa", "pb"])
    found = cells(dealt(anchors), dealt(part.select("id", "vector", "row", "label")), ["label"], F.col("pa"), F.col("pb"), positives, POSITIVE, conf)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= conf.positives)
    found = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("found"))
    anchors = saved(anchors.join(found, anchors["id"] == found["anchor"]).drop("anchor"), "anchors")

    n, m = part.count(), anchors.count()
    wide, tall = (F.lit(max(1, math.ceil(x / size))).cast("long") for x, size in ((n, conf.block), (m, conf.asked)))
    out = cells(anchors, part, [], tall, wide, negatives, NEGATIVE, conf)
    ranks = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative")
    out = out.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= conf.negatives)
    names = {"anchor": "anchor_id", "positive": "positive_id", "rank": "rank", "negative": "negative_id", "pscore": "positive_score", "score": "negative_score"}
    return out.select(*(F.col(k).alias(v) for k, v in names.items()))
