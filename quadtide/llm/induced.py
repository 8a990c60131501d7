"""Suffix sorting by induction through disk-backed queues, with common-prefix values.

A suffix is of one of two types: larger than its right neighbour in the text, or smaller. Given the sorted
leftmost smaller ones (the seeds), a sweep upwards through the order induces all larger suffixes, and a
sweep downwards from those all smaller ones: every suffix that passes puts its left neighbour into the
queue of that one's first symbol. The seeds are sorted by the same two sweeps over seeds known by their
first symbol only, which orders the substrings between seeds; their ranks make a shorter text, and
sorting that is the recursion. As suffixes need to be told apart by their first ``depth`` symbols only,
and a symbol stands for at least twice as many bytes at each level, the recursion is short; it ends in a text of
at most ``base`` symbols, which is sorted at once.

A queue entry is a suffix with the length of the prefix it shares with the entry before it: one more
than the least such value that passed since. What passes in one go is handled as arrays. Symbols with
few suffixes share a queue, which is ordered when it is read. Entries beyond ``memory`` bytes are written
to an unlinked file of the task, and texts, types and results longer than that are mapped to such files.
They are as short-lived as Spark's own sort spills; a task that runs again starts from its input.
"""

from __future__ import annotations

import sys
import tempfile
from collections import deque

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16


def room(n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros, in a file of its own from ``memory`` bytes on."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


class Tape:
    """An array written at its end, on disk beyond ``memory`` bytes."""

    def __init__(self, kind, memory: int):
        self.kind, self.memory, self.n, self.parts, self.file = np.dtype(kind), memory, 0, [], None

    def write(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.parts.append(np.ascontiguousarray(x, self.kind))
        if sum(p.nbytes for p in self.parts[-1:]) + self._held() > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p.data)
            self.parts, self._bytes = [], 0

    _bytes = 0

    def _held(self) -> int:
        self._bytes += self.parts[-1].nbytes
        return self._bytes - self.parts[-1].nbytes

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        for p in self.parts:
            self.file.write(p.data)
        self.parts = []
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,))


class Queues:
    """First in, first out, one for each of ``n`` groups of symbols."""

    def __init__(self, n: int, memory: int):
        self.memory, self.held, self.end = memory, 0, 0
        self.parts = [deque() for _ in range(n)]
        self.file = None

    def push(self, q: int, x: np.ndarray) -> None:
        self.parts[q].append(x)
        self.held += x.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts:
            live = [p for p in parts if isinstance(p, np.ndarray)]
            if live:
                x = np.concatenate(live)
                self.file.seek(self.end)
                self.file.write(x.data)
                # Parts on disk are older than all that are held.
                kept = [p for p in parts if not isinstance(p, np.ndarray)]
                parts.clear()
                parts.extend([*kept, (self.end, len(x))])
                self.end += x.nbytes
        self.held = 0

    def pop(self, q: int) -> np.ndarray | None:
        """The oldest entries, some ``CHUNK`` of them."""
        parts, out, n = self.parts[q], [], 0
        while parts and n < CHUNK:
            p = parts.popleft()
            if isinstance(p, np.ndarray):
                self.held -= p.nbytes
            else:
                at, size = p
                self.file.seek(at)
                p = np.frombuffer(self.file.read(8 * min(size, CHUNK)), np.int64)
                if size > CHUNK:
                    parts.appendleft((at + 8 * CHUNK, size - CHUNK))
            out.append(p)
            n += len(p)
        return np.concatenate(out) if out else None


def types(text: np.ndarray, memory: int) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last symbol, smallest of all, is."""
    n = len(text)
    small = room(n, np.bool_, memory)
    small[n - 1] = True
    for b in range(n - 1, 0, -CHUNK):
        a = max(0, b - CHUNK)
        x, y = text[a:b], text[a + 1 : b + 1]
        own = np.append(x < y, small[b])
        other = np.where(np.append(x != y, True), np.arange(b - a + 1), b - a)
        small[a:b] = own[np.minimum.accumulate(other[::-1])[::-1]][:-1]
    return small


class Minima:
    """Least values of ranges of a chunk."""

    def __init__(self, x: np.ndarray):
        self.rows, step = [x], 1
        while 2 * step <= len(x):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))
            step *= 2
        self.log = np.frexp(np.arange(len(x) + 1))[1] - 1

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included."""
        k, out = self.log[last - first + 1], np.empty(len(first), self.rows[0].dtype)
        for j in np.unique(k):
            at = k == j
            out[at] = np.minimum(self.rows[j][first[at]], self.rows[j][last[at] - (1 << int(j)) + 1])
        return out


class Sweep:
    """One pass through the order of suffixes, upwards or (``down``) downwards.

    Entries are position * 256 + common prefix with the entry before it in the same queue (0 without
    ``carry``). ``given`` are the entries the pass starts from, in its order; ``wanted`` marks the
    positions it induces.
    """

    def __init__(self, text, wanted, given, counts, down: bool, carry: bool, depth: int, memory: int):
        self.text, self.wanted, self.given, self.carry, self.depth = text, wanted, given, carry, depth
        self.top = len(counts) - 1 if down else None
        counts = counts[::-1] if down else counts
        # Symbols with many suffixes have a queue of their own, runs of others share one.
        many, group, self.alone = max(1, CHUNK // 32), np.zeros(len(counts), np.int64), []
        if len(counts) <= 256:
            group, self.alone = np.arange(len(counts)), [True] * len(counts)
        else:
            total, big = np.cumsum(np.where(counts > many, 0, counts)) // many, counts > many
            edge = np.zeros(len(counts), np.bool_)
            edge[0], edge[1:] = True, (total[1:] != total[:-1]) | big[1:] | big[:-1]
            group = np.cumsum(edge) - 1
            self.alone = big[np.flatnonzero(edge)].tolist()
        self.group = group.astype(np.uint16 if len(self.alone) < 1 << 16 else np.int32)
        self.queues = Queues(len(self.alone), memory)
        self.since = np.full(len(counts), -1, np.int64) if carry else None
        # What of the given entries is read, and the queues that chunk belongs to.
        self.at, self.ahead, self.queue = 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def symbol(self, p: np.ndarray) -> np.ndarray:
        c = self.text[p].astype(np.int64)
        return c if self.top is None else self.top - c

    def run(self, p: int) -> int:
        part = self.text[p : p + self.depth]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else self.depth

    def left(self, entries: np.ndarray):
        """(symbols, entries) that a chunk of the order induces."""
        p = entries >> 8
        at = np.flatnonzero(p > 0)
        at = at[self.wanted[p[at] - 1]]
        p = p[at] - 1
        c = self.symbol(p)
        if not self.carry:
            return c, p << 8
        return c, (p << 8) | self.shared(entries & 255, at, c)

    def shared(self, lcp: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        lcp = lcp.astype(np.uint8)
        order = np.argsort(c.astype(np.uint8), kind="stable")
        cs, where = c[order], at[order]
        lead = np.append(True, cs[1:] != cs[:-1])[: len(cs)]
        least, out = Minima(lcp), np.zeros(len(at), np.int64)
        if len(at):
            got = np.zeros(len(at), np.int64)
            got[~lead] = least(where[:-1][~lead[1:]] + 1, where[1:][~lead[1:]])
            running = np.minimum.accumulate(lcp)
            state = self.since[cs[lead]]
            got[lead] = np.where(state < 0, -1, np.minimum(state, running[where[lead]]))
            out[order] = np.minimum(got + 1, self.depth)
        rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], 255).astype(np.int64)
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, rest[0]))
        if len(at):
            last = np.append(lead[1:], True)
            self.since[cs[last]] = rest[where[last] + 1]
        return out

    def send(self, c: np.ndarray, entries: np.ndarray) -> None:
        if not len(c):
            return
        q = self.group[c]
        order = np.argsort(q, kind="stable")
        q, entries = q[order], entries[order]
        cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(q))):
            self.queues.push(int(q[a]), entries[a:b])

    def upto(self, q: int):
        """The given entries of a queue's symbols, in chunks."""
        while True:
            if not len(self.ahead):
                self.ahead = np.asarray(self.given[self.at : self.at + CHUNK])
                self.queue = self.group[self.symbol(self.ahead >> 8)]
                self.at += len(self.ahead)
            if not len(self.ahead) or self.queue[0] > q:
                return
            n = int(np.searchsorted(self.queue, q, "right"))
            part, self.ahead, self.queue = self.ahead[:n], self.ahead[n:], self.queue[n:]
            yield part

    def __iter__(self):
        """(entries, whether they are induced ones) in order. Common prefixes are those with the entry before."""
        for q, alone in enumerate(self.alone):
            if alone:
                last = None
                while (part := self.queues.pop(q)) is not None:
                    self.send(*self.left(part))
                    last = int(part[-1] >> 8)
                    yield part, True
                for part in self.upto(q):
                    if self.carry and last is not None:
                        part = part.copy()
                        part[0] = (part[0] >> 8 << 8) | min(self.run(last), self.run(int(part[0] >> 8)))
                        last = None
                    self.send(*self.left(part))
                    yield part, False
            else:
                yield from self.several(q)

    def several(self, q: int):
        """A queue of several symbols: ordered, and read as far as nothing it induces comes in between."""
        parts = []
        while (part := self.queues.pop(q)) is not None:
            parts.append(part)
        mine, given = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parts, list(self.upto(q))))
        key = np.concatenate([self.symbol(mine >> 8) * 2, self.symbol(given >> 8) * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, entries = key[order], np.concatenate([mine, given])[order]
        while len(key):
            p = entries >> 8
            ok = (p > 0) & self.wanted[p - 1]
            c = np.full(len(p), np.iinfo(np.int64).max)
            c[ok] = self.symbol(p[ok] - 1) * 2
            # Induced entries go behind those of their symbol that are there.
            n = max(1, int(np.count_nonzero(np.minimum.accumulate(c) >= key >> 1 << 1)))
            done, flags = entries[:n], key[:n] & 1 == 0
            new, sent = p[:n][ok[:n]] - 1, c[:n][ok[:n]] >> 1
            key, entries = key[n:], entries[n:]
            own = self.group[sent] == q
            self.send(sent[~own], new[~own] << 8)
            if own.any():
                late = np.argsort(sent[own], kind="stable")
                more, where = new[own][late] << 8, sent[own][late] * 2
                at = np.searchsorted(key, where, "right")
                key, entries = np.insert(key, at, where), np.insert(entries, at, more)
            yield done, flags


def both_sweeps(text, small, seeds, counts, carry: bool, depth: int, memory: int):
    """All suffixes but the last in descending order, in chunks of entries, from the seeds in order."""
    large = Tape(np.int64, memory)
    wanted = room(len(text), np.bool_, memory)
    for a in range(0, len(text), CHUNK):
        wanted[a : a + CHUNK] = ~small[a : a + CHUNK]
    for part, induced in Sweep(text, wanted, seeds, counts, False, carry, depth, memory):
        large.write(part[induced] if isinstance(induced, np.ndarray) else part if induced else part[:0])
    up = large.array()
    down = room(len(up), np.int64, memory)
    for a in range(0, len(up), CHUNK):
        b = min(len(up), a + CHUNK)
        # Read downwards, an entry shares with the one before it what that one shared with it upwards.
        lcp = np.append(up[a + 1 : b + 1] & 255, 0)[: b - a]
        down[len(up) - b : len(up) - a] = ((up[a:b] >> 8 << 8) | lcp)[::-1]
    for part, _ in Sweep(text, small, down, counts, True, carry, depth, memory):
        yield part


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes, up to ``depth``."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(text)
    for d in range(depth):
        x, y = a[live] + d, b[live] + d
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def in_order(text, small, seeds, counts, level: int, depth: int, memory: int, base: int) -> np.ndarray:
    """The seeds in the order of their suffixes, as far as ``depth`` bytes tell them apart."""
    first = np.argsort(text[seeds], kind="stable")
    known = seeds[first] << 8
    is_seed = room(len(text), np.bool_, memory)
    is_seed[seeds] = True
    found = Tape(np.int64, memory)
    for part in both_sweeps(text, small, known, counts, False, depth, memory):
        p = part >> 8
        found.write(p[is_seed[p]])
    order = np.append(found.array(), len(text) - 1)[::-1]
    # Substrings between seeds, both ends included, get equal names if they are equal.
    place = np.searchsorted(seeds, order)
    ends = np.append(seeds[1:], len(text) - 1)[place]
    size = ends - order + 1
    new = np.ones(len(order), np.bool_)
    for a in range(1, len(order), CHUNK):
        b = min(len(order), a + CHUNK)
        same = np.flatnonzero(size[a - 1 : b - 1] == size[a:b]) + a
        if len(same):
            x, y, s = order[same - 1], order[same], size[same]
            got = common(text, x, y, int(s.max()))
            new[same] = got < s
    names = np.cumsum(new) - 1
    if names[-1] + 1 == len(names) or 2 << level >= depth:
        return order
    shorter = room(len(names), np.int32 if len(names) < 1 << 31 else np.int64, memory)
    shorter[place] = names
    return seeds[suffix_array(shorter, level + 1, depth, memory, base)]


def doubled(text: np.ndarray, enough: int) -> np.ndarray:
    """The suffix array of a short text, by ``enough`` symbols."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        ahead = np.append(rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64))
        rank = np.unique(rank * (len(text) + 1) + ahead, return_inverse=True)[1]
        k *= 2
        if k >= enough or rank.max() == len(rank) - 1:
            return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, level: int, depth: int, memory: int, base: int) -> np.ndarray:
    """The positions of a text in the order of their suffixes."""
    if len(text) <= base:
        return doubled(np.asarray(text), -(-depth >> level))
    tape = Tape(np.int64, memory)
    for part in descending(text, level, depth, memory, base, carry=False):
        tape.write(part >> 8)
    return np.append(tape.array(), len(text) - 1)[::-1]


def descending(text: np.ndarray, level: int = 0, depth: int = 50, memory: int = 64 << 20, base: int = 1 << 21, carry: bool = True):
    """Chunks of position * 256 + common prefix with the entry before, up to ``depth`` (below 256), for all
    suffixes but the last, in descending order as far as ``depth`` symbols tell them apart.

    The last symbol of the text is 0 and smaller than all others.
    """
    small = types(text, memory)
    marks = Tape(np.int64, memory)
    for a in range(1, len(text), CHUNK):
        b = min(len(text), a + CHUNK)
        marks.write(np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a)
    seeds = marks.array()
    counts = np.zeros(int(text.max()) + 1, np.int64)
    step = max(CHUNK, len(counts))
    for a in range(0, len(text), step):
        counts += np.bincount(text[a : a + step], minlength=len(counts))
    if not len(seeds):
        return
    order = in_order(text, small, seeds, counts, level, depth, memory, base)
    given = room(len(order), np.int64, memory)
    for a in range(0, len(order), CHUNK):
        part = np.asarray(order[a : a + CHUNK])
        before = np.append(order[a - 1] if a else part[0], part[:-1])
        lcp = common(text, before, part, depth) if carry else 0
        if carry and not a:
            lcp[0] = 0
        given[a : a + CHUNK] = part << 8 | lcp
    yield from both_sweeps(text, small, given, counts, carry, depth, memory)
