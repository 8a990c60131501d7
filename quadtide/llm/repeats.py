"""Removal of repeated passages by external suffix sorting of content-defined shards.

A window is ``window`` bytes of one text. Its anchor is the smallest hash among its short substrings, so
equal windows have equal anchors wherever they stand, and shards made by a hash of the anchor hold all
places of a window: no match is lost between shards, and none needs another shard. Neighbouring windows
with one anchor travel as one piece of text.

A shard is sorted by induced suffix sorting (``induced``): its texts, queues and orders are on disk beyond
``memory`` bytes. In the order, suffixes that share ``window`` bytes are neighbours, and the smallest
document among them owns the window; all others lose it. Pieces that are equal are carried as one with their
smallest document. Pieces whose anchor, or all of whose stretches around it, are in one document only have no
partner to be compared with and are not sorted.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import column, saved, small_batches
from quadtide.llm.induced import CHUNK, Tape, descending, room

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A document without an id comes after all others.
LAST = (1 << 63) - 1

#: Bytes of text that are cut into pieces at a time.
SLAB = 1 << 20

#: Stretches around an anchor by which pieces without a common window are told apart.
STRETCHES = 4

PIECES = [("size", np.uint32), ("start", np.uint32), ("place", np.uint8), ("id", np.int64), ("key", np.int64)]


@dataclass(frozen=True)
class Repeats:
    """A byte goes if a string of ``window`` bytes over it also starts in a document of smaller id.
    Anchors are ``anchor`` bytes; a piece has at most ``longest`` windows; about ``shard`` bytes of text
    make a shard; tasks hold about ``memory`` bytes of each of their buffers."""

    window: int = 50
    anchor: int = 16
    longest: int = 4096
    shard: int = 6 << 20
    memory: int = 32 << 20


def hashed(x: np.ndarray, size: int, begin: np.ndarray | None = None) -> np.ndarray:
    """A hash of each substring of ``size`` bytes, or of those that start at ``begin``."""
    hashes, unit = np.zeros(len(x) - size + 1 if begin is None else len(begin), np.uint64), 8 if size >= 8 else 4
    words = np.ndarray((max(0, len(x) - unit + 1),), f"<u{unit}", np.ascontiguousarray(x), strides=(1,))
    for at in [*range(0, size - unit, unit), size - unit]:
        hashes ^= words[at : at + len(hashes)] if begin is None else words[begin + at]
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return hashes


def anchors(x: np.ndarray, conf: Repeats, hashes: np.ndarray | None = None) -> np.ndarray:
    """The smallest hash in each window of some bytes."""
    n, hashes = len(x) - conf.window + 1, hashed(x, conf.anchor) if hashes is None else hashes
    width, size = conf.window - conf.anchor + 1, 1
    while 2 * size <= width:
        hashes = np.minimum(hashes[:-size], hashes[size:])
        size *= 2
    return np.minimum(hashes[:n], hashes[width - size : width - size + n]) if size < width else hashes[:n]


def gather(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``x``, one after the other."""
    shift = start.astype(np.int64) - np.append(0, np.cumsum(size, dtype=np.int64)[:-1])[: len(size)]
    return x[np.repeat(shift, size) + np.arange(int(size.sum(dtype=np.int64)))]


def places(hashes: np.ndarray, first: np.ndarray, low: np.ndarray, conf: Repeats) -> np.ndarray:
    """How far behind the start of a window, at ``first``, its anchor ``low`` stands, once at least."""
    width = conf.window - conf.anchor + 1
    place = np.full(len(first), width - 1, np.uint8)
    # Every other anchor or so has just come in at the window's end.
    rest = np.flatnonzero(hashes[first + width - 1] != low)
    for a in range(0, len(rest), CHUNK):
        part = rest[a : a + CHUNK]
        place[part] = (np.lib.stride_tricks.sliding_window_view(hashes, width)[first[part]] == low[part, None]).argmax(1)
    return place


def pieces(x: np.ndarray, ends: np.ndarray, conf: Repeats, hashes: np.ndarray | None = None):
    """(document, start in ``x``, size, anchor) of the pieces of documents that end at ``ends`` in ``x``."""
    if len(x) < conf.window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    low = anchors(x, conf, hashes)
    # A piece starts where the anchor changes, and with each document; what is left of it at the document's
    # end has no room for a window.
    begins = ends - np.diff(ends, prepend=0)
    last = np.minimum(ends - conf.window + 1, len(low))
    lead = np.flatnonzero(low[1:] != low[:-1]) + 1
    own = begins[last > begins]
    first = np.unique(np.concatenate([lead, own]))
    doc = np.searchsorted(ends, first, "right")
    ok = first < last[doc]
    first, doc = first[ok], doc[ok]
    windows = np.minimum(np.append(first[1:], len(low)), last[doc]) - first
    if len(windows) and windows.max() > conf.longest:
        parts = -(-windows // conf.longest)
        at = np.repeat(np.arange(len(parts)), parts)
        shift = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)) * conf.longest
        first, doc, windows = first[at] + shift, doc[at], np.minimum(windows[at] - shift, conf.longest)
    return doc, first, windows + conf.window - 1, low[first]


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each ends; nulls are empty."""
    a = a.cast(pa.binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def sharded(rows: DataFrame, shards: int, conf: Repeats) -> DataFrame:
    """(``shard``, ``part``): compressed pieces of the texts, about ``memory`` bytes of them at a time."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.binary())])

    def cut(batches):
        held, size, pack = {}, 0, zstandard.ZstdCompressor(level=3).compress

        def out():
            for shard, parts in held.items():
                columns = [planes(np.concatenate([p[j] for p in parts])) for j in range(len(PIECES) + 1)]
                count = sum(len(p[0]) for p in parts).to_bytes(8, "little")
                part = pack(b"".join([count, *columns]))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.binary())], schema=schema)
            held.clear()

        for b in batches:
            x, ends = _bytes_of(b.column(2))
            begins = np.append(0, ends[:-1])
            ids, keys = (b.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            # By windows that start in one slab, so a long text takes no more memory than others.
            for s in range(0, len(x), SLAB):
                part = x[s : s + SLAB + conf.window - 1]
                if len(part) < conf.window:
                    continue
                hashes = hashed(part, conf.anchor)
                doc, start, length, low = pieces(part, np.clip(ends - s, 0, len(part)), conf, hashes)
                place = places(hashes, start, low, conf)
                low = (low ^ (low >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                shard = ((low >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                doc, start, length, place, shard = (v[order] for v in (doc, start, length, place, shard))
                texts, text_ends, at = gather(part, start, length), np.cumsum(length), start + s - begins[doc]
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)]
                for i, j in zip(cuts, np.append(cuts[1:], len(shard))):
                    own = [length[i:j], at[i:j], place[i:j], ids[doc[i:j]], keys[doc[i:j]]]
                    text = texts[text_ends[i] - length[i] : text_ends[j - 1]]
                    held.setdefault(int(shard[i]), []).append([*(v.astype(k) for v, (_, k) in zip(own, PIECES)), text.copy()])
                size += len(texts) + 25 * len(doc)
                if size > conf.memory:
                    yield from out()
                    size = 0
        yield from out()

    return rows.select("id", "key", "text").mapInArrow(cut, "shard int, part binary")


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by their place in the number, which compress better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unpacked(part: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(part)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _, kind in PIECES:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [*out, np.frombuffer(raw, np.uint8, -1, at)]


class Shard:
    """The pieces of one shard. Their texts, and a few numbers for each, are on disk beyond ``memory``."""

    def __init__(self, conf: Repeats):
        self.conf, self.waiting, self.bytes, self.n = conf, [], 0, 0
        tape = lambda kind: Tape(kind, conf.memory)
        self.text = tape(np.uint8)
        # Of different pieces: size, anchor and its place, smallest document. Of all: piece, document, key, start.
        self.size, self.mark, self.place, self.owner = tape(np.int64), tape(np.uint64), tape(np.uint8), tape(np.int64)
        self.piece, self.id, self.key, self.start = tape(np.int64), tape(np.int64), tape(np.int64), tape(np.int64)

    def add(self, part: bytes) -> None:
        self.waiting.append(unpacked(part))
        self.bytes += len(self.waiting[-1][-1])
        if self.bytes > self.conf.memory:
            self.settle()

    def settle(self, whole: bool = False) -> None:
        """Equal pieces among those waiting become one; those with no partner go if the ``whole`` shard is waiting."""
        if not self.waiting:
            return
        size, start, place, ids, keys, text = (np.concatenate([w[j] for w in self.waiting]) for j in range(len(PIECES) + 1))
        self.waiting, self.bytes = [], 0
        ends = np.cumsum(size, dtype=np.int64)
        begins = ends - size
        mark = hashed(text, self.conf.anchor, begins + place)
        if whole:
            several = np.flatnonzero(differing(mark, ids))
            size, start, place, ids, keys, begins, ends, mark = (v[several] for v in (size, start, place, ids, keys, begins, ends, mark))
        raw, known = text.tobytes(), {}
        which = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(begins.tolist(), ends.tolist())), np.int64, len(size))
        owner, first = np.full(len(known), LAST, np.int64), np.full(len(known), len(size), np.int64)
        np.minimum.at(owner, which, ids)
        np.minimum.at(first, which, np.arange(len(size)))
        self.text.write(gather(text, begins[first], size[first]))
        for tape, values in ((self.size, size[first]), (self.mark, mark[first]), (self.place, place[first]), (self.owner, owner)):
            tape.write(values)
        for tape, values in ((self.piece, which + self.n), (self.id, ids), (self.key, keys), (self.start, start)):
            tape.write(values)
        self.n += len(known)

    def spans(self):
        """Arrays (id, key, start, end): what loses its windows to a smaller document."""
        self.settle(whole=not self.n)
        if not self.n:
            return
        size, mark, place, owner = (t.array() for t in (self.size, self.mark, self.place, self.owner))
        piece, ids, keys, start = (t.array() for t in (self.piece, self.id, self.key, self.start))
        own, begin, end = owned_elsewhere(self.text.array(), size, mark, place, owner, self.conf)
        to = np.searchsorted(own, np.arange(self.n + 1))
        for a in range(0, len(piece), CHUNK):
            p, i, k, s = piece[a : a + CHUNK], ids[a : a + CHUNK], keys[a : a + CHUNK], start[a : a + CHUNK]
            # A later document than a piece's owner loses the whole piece, the owner what others own.
            late = np.flatnonzero(i > owner[p])
            yield i[late], k[late], s[late], s[late] + size[p[late]]
            mine = np.flatnonzero((i == owner[p]) & (to[p + 1] > to[p]))
            count = to[p[mine] + 1] - to[p[mine]]
            at = gather(np.arange(len(own)), to[p[mine]], count)
            mine = np.repeat(mine, count)
            yield i[mine], k[mine], s[mine] + begin[at], s[mine] + end[at]


def owned_elsewhere(text, size, mark, place, owner, conf: Repeats):
    """(piece, begin, end): runs of windows of a piece that a smaller document than its own has in other pieces."""
    kept = with_partner(text, size, mark, place, owner, conf)
    none = np.empty(0, np.int64)
    if not len(kept):
        return none, none, none
    # The texts of the pieces, each behind its end mark: 0 ends all, 1 ends a piece; no UTF-8 byte exceeds 0xF4.
    total = int(size[kept].sum()) + len(kept) + 1
    joined, begins = room(total, np.uint8, conf.memory), np.cumsum(size) - size
    starts = np.cumsum(size[kept] + 1) - size[kept] - 1
    for a in range(0, len(kept), CHUNK):
        k = kept[a : a + CHUNK]
        joined[starts[a] : starts[a] + int(size[k].sum()) + len(k)] = 1
        for_each = gather(np.arange(total), starts[a : a + CHUNK], size[k])
        joined[for_each] = gather(text, begins[k], size[k]) + np.uint8(2)
    last, owners = starts + size[kept] - conf.window, owner[kept]
    found = Tape(np.int64, conf.memory)

    def settle(group: list[np.ndarray]) -> None:
        """Windows of a group of equal ones whose document is not the smallest among them."""
        p = np.concatenate([g[0] for g in group])
        lead = np.concatenate([g[1] for g in group])
        at = np.searchsorted(starts, p, "right") - 1
        whole = p <= last[at]
        p, at, number = p[whole], at[whole], np.cumsum(lead)[whole]
        if not len(p):
            return
        heads = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        least = np.minimum.reduceat(owners[at], heads)
        least = np.repeat(least, np.diff(np.append(heads, len(p))))
        found.write(p[least < owners[at]])

    open_group: list[tuple[np.ndarray, np.ndarray]] = []
    for part in descending(joined, 0, conf.window, conf.memory):
        p, lead = part >> 8, (part & 255) < conf.window
        # A suffix that shares too little with both neighbours is alone.
        heads = np.flatnonzero(lead)
        if not len(heads):
            open_group.append((p, lead))
            continue
        open_group.append((p[: heads[0]], lead[: heads[0]]))
        if sum(len(g[0]) for g in open_group) > 1:
            settle(open_group)
        several = ~lead[heads[0] : heads[-1]]
        several |= np.append(several[1:], False)
        settle([(p[heads[0] : heads[-1]][several], lead[heads[0] : heads[-1]][several])])
        open_group = [(p[heads[-1] :], lead[heads[-1] :])]
    if open_group:
        settle(open_group)
    p = np.sort(found.array())
    if not len(p):
        return none, none, none
    at = np.searchsorted(starts, p, "right") - 1
    lead = np.append(True, (p[1:] != p[:-1] + 1) | (at[1:] != at[:-1]))
    heads = np.flatnonzero(lead)
    ends = p[np.append(heads[1:], len(p)) - 1]
    return kept[at[heads]], p[heads] - starts[at[heads]], ends - starts[at[heads]] + conf.window


def differing(name: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether rows of a row's name have different values."""
    if not len(name):
        return np.empty(0, np.bool_)
    order = np.argsort(name)
    name, value = name[order], value[order]
    heads = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    several = np.minimum.reduceat(value, heads) != np.maximum.reduceat(value, heads)
    out = np.empty(len(name), np.bool_)
    out[order] = np.repeat(several, np.diff(np.append(heads, len(name))))
    return out


def with_partner(text, size, mark, place, owner, conf: Repeats) -> np.ndarray:
    """The pieces that may have a window in common with a piece of another smallest document.

    Equal windows have their anchor at the same place, so around the anchors of their pieces one of a few
    stretches is equal too: those that reach as far to the left and right as windows do in which the anchor has
    at least some place and less than the next one. Pieces in which their anchor stands twice are not told apart.
    """
    begins = np.cumsum(size) - size
    kept = np.flatnonzero(differing(mark, owner))
    if not len(kept):
        return kept
    again = np.zeros(len(kept), np.bool_)
    for a in range(0, len(kept), CHUNK):
        k = kept[a : a + CHUNK]
        part, ends = gather(text, begins[k], size[k]), np.cumsum(size[k])
        of = np.repeat(np.arange(len(k)), size[k])[: len(part) - conf.anchor + 1]
        at = np.flatnonzero(hashed(part, conf.anchor) == mark[k][of])
        inside = at[at + conf.anchor <= ends[of[at]]]
        again[a : a + CHUNK] = np.bincount(of[inside], minlength=len(k)) > 1
    ok = np.isin(mark[kept], mark[kept[again]])
    spare = conf.window - conf.anchor
    step = (spare + STRETCHES) // STRETCHES
    for left in range(0, spare + 1, step):
        right = max(0, spare - left - step + 1)
        anchor = place[kept].astype(np.int64)
        at = np.flatnonzero((anchor >= left) & (anchor + conf.anchor + right <= size[kept]))
        names = hashed(text, left + conf.anchor + right, begins[kept[at]] + anchor[at] - left)
        ok[at[differing(names, owner[kept[at]])]] = True
    return kept[ok]


def lost(parts: DataFrame, shards: int, conf: Repeats) -> DataFrame:
    """(``id``, ``key``, ``start``, ``end``) of the bytes each document loses, from all shards."""
    names = ["id", "key", "start", "end"]

    def sort(batches):
        shard, now = None, None

        def out(done):
            for arrays in done.spans():
                for a in range(0, len(arrays[0]), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(v[a : a + CHUNK], pa.int64()) for v in arrays], names)

        for b in batches:
            for s, part in zip(b.column(0).to_pylist(), b.column(1)):
                if s != now:
                    if shard is not None:
                        yield from out(shard)
                    shard, now = Shard(conf), s
                shard.add(part.as_py())
        if shard is not None:
            yield from out(shard)

    dealt = small_batches(parts, 16).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(sort, "id long, key long, start long, end long")


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of some bytes, and the maximal runs that are not."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), [tuple(r) for r in runs]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: Repeats = Repeats()) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_bytes``, the removed ``runs`` (``start``, ``end``) in bytes of
    the UTF-8 text, and ``kept``, the bytes that are left.

    A byte is removed if a string of ``window`` bytes over it also starts in a document with a smaller id;
    texts are judged as they came in, and repeats within one document stay. A null text counts as empty.
    Documents with a null id come after all others. Rows that repeat an id are one document: they lose
    nothing to each other. Texts are read whole; other columns are not looked at; an empty table gives none.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    own = column(docs, id_col).cast("long")
    # Bytes of the texts, each about three times among the pieces.
    total, count, names = docs.agg(F.sum(F.octet_length(text)), F.count("*"), F.count_distinct(own)).first()
    shards = max(1, -(-3 * (total or 0) // conf.shard))
    # Ids that name one row each do so without a hash of its text.
    key = F.lit(0).cast("long") if count == names else F.xxhash64(own, text)
    rows = docs.select(F.coalesce(own, F.lit(LAST)).alias("id"), key.alias("key"), text.alias("text"), own.alias("name"))
    spans = saved(lost(sharded(small_batches(rows), shards, conf), shards, conf), "lost")
    small_batches(rows)
    spans = spans.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = rows.join(spans, ["id", "key"], "left").select("name", "text", "spans")

    def finish(batches):
        for b in batches:
            kept, runs, size = [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                data = t.as_py().encode()
                left, gone = without(data, [] if not s.is_valid else list(zip(*(s.values.field(j).to_pylist() for j in (0, 1)))))
                kept.append(left)
                runs.append([{"start": x, "end": y} for x, y in gone])
                size.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "runs", "kept"])

    return both.mapInArrow(finish, "id long, n_bytes long, runs array<struct<start:long,end:long>>, kept binary")
