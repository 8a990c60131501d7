"""Near duplicates by MinHash with sequential Bayesian verification.

Texts with equal shingle sets form one class, and all further work is on classes, so copies cost one
row each. MinHash signatures are cut into bands; classes that agree on a band are candidates. Inside a
bucket of a band every member is compared with the bucket's smallest class only, and the links found
give components. Buckets that then still hold several components compare members of different ones in
blocks: signatures first, which gives families of look-alike components, then the full sets within a
family. So no link between different texts is lost, members already joined are never paired, and what a
task compares leaves it as a spanning forest over components instead of as pairs.

A candidate pair is verified in three steps: set sizes that exclude the threshold; signatures read in
batches, dropping the pair as soon as the posterior probability of reaching the threshold (uniform
prior, so a binomial tail) falls below ``miss``; survivors on their full shingle sets.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import Shingler, column, fresh, saved, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class NearDup:
    """``k`` words a shingle; linked if ``den * common >= num * union``.

    ``rows`` hashes make a band, and there are as many bands as keep the chance of missing a pair at
    the threshold below ``band_miss``. ``miss`` is the chance of dropping a true pair at each batch of
    ``batch`` compared hashes. At most ``sent`` rows of 24 bytes are broadcast.
    """

    k: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    band_miss: float = 1e-8
    batch: int = 32
    miss: float = 1e-7
    seed: int = 7
    sent: int = 500_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log1p(-((self.num / self.den) ** self.rows)))

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest matches that keep a pair) after each batch."""
        out, t = [], self.num / self.den
        for n in range(self.batch, self.bands * self.rows + 1, self.batch):
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def minhash(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; different minima agree with probability 2**-16."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = mul[:, None] * x[None, i : i + 2048]
        part += add[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def hashes(text) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def signatures(docs: DataFrame, id_col: str, text_col: str, conf: NearDup) -> DataFrame:
    """One row per document: ``id``, the hash ``h1``, ``h2`` of its text, ``n`` shingles, ``cls`` (null if
    none) and its ``sig``."""
    mul, add = conf.permutations()

    def sign(batches):
        shingles = Shingler(conf.k)
        for b in batches:
            n, cls, sig = [], [], []
            for text in b.column(3):
                h = shingles(text.as_py())
                n.append(len(h))
                cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(minhash(h, mul, add).tobytes() if len(h) else None)
            made = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["id", "h1", "h2", "n", "cls", "sig"])

    text = column(docs, text_col).cast("string")
    rows = small_batches(docs).select(column(docs, id_col).cast("long").alias("id"), *hashes(text), text.alias("text"))
    return rows.mapInArrow(sign, "id long, h1 long, h2 long, n long, cls binary, sig binary")


def band_rows(classes: DataFrame, conf: NearDup) -> DataFrame:
    """A row (``bk``, ``id``) for each band of each class."""
    width = conf.rows * 2

    def cut(batches):
        for b in batches:
            ids, keys = [], []
            for i, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids += [i] * conf.bands
                keys += [xxhash.xxh3_64_intdigest(sig[j * width : (j + 1) * width], seed=j) for j in range(conf.bands)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids, pa.int64())], ["bk", "id"])

    return classes.select("id", "sig").mapInArrow(cut, "bk long, id long")


def plausible(pairs: DataFrame, classes: DataFrame, conf: NearDup) -> DataFrame:
    """The pairs (``a``, ``b``) that signatures do not rule out."""
    steps = conf.least_matches()

    def compare(batches):
        for t in batches:
            a = np.frombuffer(b"".join(t.column("sa").to_pylist()), np.uint16).reshape(t.num_rows, -1)
            b = np.frombuffer(b"".join(t.column("sb").to_pylist()), np.uint16).reshape(t.num_rows, -1)
            alive, seen, found = np.arange(t.num_rows), 0, np.zeros(t.num_rows, np.int32)
            for n, least in steps:
                found[alive] += (a[alive, seen:n] == b[alive, seen:n]).sum(axis=1)
                alive, seen = alive[found[alive] >= least], n
                if not len(alive):
                    break
            yield t.select(["a", "b"]).take(pa.array(alive))

    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("na", "nb") * conf.den >= F.greatest("na", "nb") * conf.num
    return both.where(sizes).select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, conf: NearDup) -> DataFrame:
    """(``id``, ``text``), one text of each class in ``nodes``. The table of classes that are asked for is sent
    to the texts while it has at most ``conf.sent`` rows of 24 bytes; beyond that both are shuffled."""
    asked = saved(nodes.join(classes.select("id", "h1", "h2"), "id"), "asked")
    text = column(docs, text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(*hashes(text), text.alias("text"))
    found = rows.join(F.broadcast(asked) if asked.count() <= conf.sent else asked, ["h1", "h2"])
    # Copies of a text are dropped in their own tasks first.
    return found.select("id", "text").dropDuplicates(["id"])


def exact_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, conf: NearDup) -> DataFrame:
    """The pairs of classes whose full shingle sets reach the threshold."""

    def verify(batches):
        shingles, last = Shingler(conf.k), (None, None)
        for t in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(t.column("a").to_pylist(), t.column("ta"), t.column("tb"))):
                if last[0] != a:
                    last = (a, shingles(ta.as_py()))
                x, y = last[1], shingles(tb.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                if conf.den * common >= conf.num * (len(x) + len(y) - common):
                    keep.append(i)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts_of(ends, classes, docs, text_col, conf)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``root``): the smallest id each linked id reaches, by large-star and small-star steps."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = tuple(mark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


class Forest:
    """Edges between components, without those that join what earlier ones of the task have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def new(self, edges) -> list[tuple[int, int]]:
        out = []
        for a, b in edges:
            x, y = self._top(a), self._top(b)
            if x != y:
                self.up[x] = y
                out.append((a, b))
        return out


def _members(col: pa.Array, i: int, *names: str) -> list:
    got = col[i].values
    return [got.field(x) for x in names]


def _open_pairs(t: pa.RecordBatch, i: int):
    """Members of both blocks of a row, and the pairs of them that belong to different components."""
    (ia, ra), (ib, rb) = (_members(t.column(c), i, "id", "root") for c in ("one", "two"))
    ids = np.concatenate([ia.to_numpy(zero_copy_only=False), ib.to_numpy(zero_copy_only=False)])
    roots = np.concatenate([ra.to_numpy(zero_copy_only=False), rb.to_numpy(zero_copy_only=False)])
    x, y = np.meshgrid(np.arange(len(ia)), np.arange(len(ia), len(ids)), indexing="ij")
    x, y = x.ravel(), y.ravel()
    ok = roots[x] != roots[y]
    if t.column("same")[i].as_py():
        ok &= ids[x] < ids[y]
    return roots, x[ok], y[ok]


def _batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[j] for e in edges], pa.int64()) for j in (0, 1)], ["a", "b"])


def block_pairs(rows: DataFrame, key: str, payload: list[str], size: int) -> DataFrame:
    """Rows of ``key`` with its ``id`` and ``root`` dealt into blocks of about ``size`` members, and the
    pairs of blocks that can hold different roots. A root that fills blocks of its own is not paired
    with itself. Blocks are dealt by a hash of the id, so no key is ordered or counted in one place."""
    sizes = rows.groupBy(key, "root").agg(F.count("*").alias("m"))
    sizes = sizes.select(key, "root", F.when(F.col("m") >= size, F.col("root")).alias("own"), "m")
    pools = sizes.groupBy(key, "own").agg(F.sum("m").alias("pool"))
    named = sizes.alias("s").join(pools.alias("p"), F.col(f"s.{key}").eqNullSafe(F.col(f"p.{key}")) & F.col("s.own").eqNullSafe(F.col("p.own")))
    named = named.select(F.col(f"s.{key}").alias(key), "root", F.col("s.own").alias("own"), F.ceil(F.col("pool") / size).alias("parts"))
    dealt = rows.join(named, [key, "root"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    blocks = dealt.groupBy(key, "own", "part").agg(F.collect_list(F.struct("id", "root", *payload)).alias("block"))
    one = blocks.select(key, F.col("own").alias("oa"), F.col("part").alias("pa"), F.col("block").alias("one"))
    two = blocks.select(key, F.col("own").alias("ob"), F.col("part").alias("pb"), F.col("block").alias("two"))
    order = lambda o, p: F.struct(F.coalesce(o, F.lit(-(1 << 63))), p)
    both = one.join(two, key).where(order(F.col("oa"), F.col("pa")) <= order(F.col("ob"), F.col("pb")))
    both = both.where("oa IS NULL OR ob IS NULL OR oa != ob")
    return both.select((F.col("oa").eqNullSafe(F.col("ob")) & (F.col("pa") == F.col("pb"))).alias("same"), "one", "two")


def look_alikes(rows: DataFrame, conf: NearDup) -> DataFrame:
    """Edges between roots with members that signatures do not rule out, among rows (``bk``, ``id``,
    ``root``, ``n``, ``sig``)."""
    steps = conf.least_matches()

    def compare(batches):
        forest = Forest()
        for t in batches:
            out = []
            for i in range(t.num_rows):
                roots, x, y = _open_pairs(t, i)
                parts = [_members(t.column(c), i, "n", "sig") for c in ("one", "two")]
                n = np.concatenate([p[0].to_numpy(zero_copy_only=False) for p in parts])
                sig = np.frombuffer(b"".join(s for p in parts for s in p[1].to_pylist()), np.uint16).reshape(len(roots), -1)
                ok = np.minimum(n[x], n[y]) * conf.den >= np.maximum(n[x], n[y]) * conf.num
                x, y, seen, found = x[ok], y[ok], 0, np.zeros(ok.sum(), np.int32)
                for upto, least in steps:
                    found += (sig[x, seen:upto] == sig[y, seen:upto]).sum(axis=1, dtype=np.int32)
                    ok = found >= least
                    x, y, found, seen = x[ok], y[ok], found[ok], upto
                out += forest.new(zip(roots[x].tolist(), roots[y].tolist()))
            yield _batch(out)

    return block_pairs(rows, "bk", ["n", "sig"], 64).mapInArrow(compare, "a long, b long").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, exact; memory is bounded by strips of the vocabulary."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    total, strip = np.zeros((len(sets), len(sets)), np.int64), 1 << 14
    cuts = np.searchsorted(where, np.arange(0, len(vocabulary) + strip, strip))
    for k in range(len(cuts) - 1):
        part = np.zeros((len(sets), strip), np.float32)
        part[owner[cuts[k] : cuts[k + 1]], where[cuts[k] : cuts[k + 1]] - k * strip] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def family_links(rows: DataFrame, conf: NearDup) -> DataFrame:
    """Edges between roots with members that are linked, among rows (``family``, ``id``, ``root``, ``text``)."""

    def verify(batches):
        shingles, forest = Shingler(conf.k), Forest()
        for t in batches:
            out = []
            for i in range(t.num_rows):
                roots, x, y = _open_pairs(t, i)
                sets = [shingles(s) for c in ("one", "two") for s in _members(t.column(c), i, "text")[0].to_pylist()]
                n, common = np.array([len(s) for s in sets]), common_counts(sets)[x, y]
                ok = conf.den * common >= conf.num * (n[x] + n[y] - common)
                out += forest.new(zip(roots[x[ok]].tolist(), roots[y[ok]].tolist()))
            yield _batch(out)

    return small_batches(block_pairs(rows, "family", ["text"], 64), 4).mapInArrow(verify, "a long, b long").distinct()


def connected(docs: DataFrame, id_col: str, text_col: str, conf: NearDup) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``h1``, ``h2``, ``n``, ``root`` (a number its component has for
    itself, null without shingles) and ``component``.

    Classes are numbered as they are written, so a document needs no id to be linked.
    """
    signed = saved(signatures(docs, id_col, text_col, conf), "signed")
    classes = signed.where("cls IS NOT NULL").groupBy("cls")
    classes = classes.agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("h1", "h2")).alias("h"))
    classes = saved(classes.select("cls", "least", "n", "sig", "h.*", F.monotonically_increasing_id().alias("id")), "classes")
    known = classes.select("id", "n", "sig")
    bands = band_rows(known, conf)
    leads = bands.groupBy("bk").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last")
    shared = saved(bands.join(leads, "bk").select("bk", "lead", "id"), "bands")

    stars = shared.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    maybe = saved(plausible(stars, known, conf), "plausible")
    links = saved(exact_links(maybe, classes, docs, text_col, conf), "links")
    roots = components(links)

    # Members of one bucket that its star has not connected.
    labelled = shared.select("bk", "id").join(roots, "id", "left").select("bk", "id", F.coalesce("root", "id").alias("root"))
    mixed = labelled.groupBy("bk").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bk")
    open_rows = labelled.join(mixed, "bk").join(known, "id")
    alike = saved(look_alikes(open_rows, conf), "alike")
    if not alike.isEmpty():
        families = components(alike).toDF("root", "family")
        families = families.union(families.select("family", "family").distinct())
        members = roots.select("id", "root").union(families.select("root", "root")).union(roots.select("root", "root")).distinct()
        families = saved(members.join(families, "root").select("id", "root", "family"), "families")
        rows = texts_of(families.select("id").distinct(), classes, docs, text_col, conf).join(families, "id")
        more = saved(family_links(rows, conf), "links")
        small_batches(docs)
        roots = components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more))

    named = saved(classes.select("cls", "id", "least").join(roots, "id", "left").select("cls", "least", F.coalesce("root", "id").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("cls", "root", "component")
    out = signed.select("id", "h1", "h2", "n", "cls").join(named, "cls", "left")
    return out.select("id", "h1", "h2", "n", "root", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n`` (set size), ``component`` (smallest id reachable).

    Null, empty and white-space texts have no shingles, size 0, and are alone. Documents without an id are
    linked like others, and their component is null only where none of it has an id. Rows that repeat an
    id are documents of their own, linked by their texts only. Any length of text is read whole; other
    columns are not looked at; an empty table gives none.
    """
    return connected(docs, id_col, text_col, conf).select("id", "n", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: NearDup = NearDup()) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, null last, ties to the smallest
    hash of the text; equal rows once.

    Rows without shingles, of null, empty or white-space texts, are components of their own; those with
    the same id (or none) and text are equal. The row of a component is chosen by id and hash before
    texts move, and each text moves once. Columns stay as they are; an empty table gives none.
    """
    found = connected(docs, id_col, text_col, conf).withColumn("none", F.col("id").isNull())
    key = F.struct("none", "id", "h1", "h2")
    chosen = found.where("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    chosen = chosen.union(found.where("root IS NULL").select("none", "id", "h1", "h2").distinct())
    own = fresh(docs, "kept_none", "kept_id", "kept_h1", "kept_h2")
    chosen = chosen.select("none", F.coalesce("id", F.lit(0)), "h1", "h2").toDF(*own)
    i, text = column(docs, id_col).cast("long"), column(docs, text_col).cast("string")
    rows = docs.withColumns(dict(zip(own, [i.isNull(), F.coalesce(i, F.lit(0)), *hashes(text)])))
    # Both steps ask for the same keys, so the second finds its rows in place and in order.
    return rows.join(chosen, own, "left_semi").dropDuplicates(own).drop(*own)
