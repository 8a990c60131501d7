"""Cost-balanced packing of token sequences.

Attention makes a sequence cost a linear and a quadratic term per document in it. Documents, longest
first, go to the cheapest sequence that still has room; where none has, the document is cut. Each task
packs the rows it reads, some ``group`` tokens at a time, so nothing is shuffled and memory is bounded
by a group and the longest document. A group fills whole sequences only and hands what is left to the
next; the last one of a task ends in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from quadtide.llm.common import column, small_batches, worker_memo

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Punctuation that is a pre-token of its own after a letter.
TAIL = b".,;:!?%&*$#|"


class Codes(dict):
    """Numbers pieces in the order they are first asked for."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = code = len(self)
        self.new.append(piece)
        return code


class ChunkTokenizer:
    """Token ids of whole texts, reading each distinct piece between ASCII white space once.

    For tokenizers that drop white space, fold case and split letters from punctuation, whose pre-tokens
    so never span white space. Pieces that are a Latin word and punctuation skip the normaliser, which
    would change nothing. Texts that may hold a special token's string are encoded as they are.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.words, self.limit = Tokenizer.from_file(path), Tokenizer.from_file(path), limit
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.codes = Codes()
        self.codes.new = []
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Append the ids of the pieces numbered since the last call."""
        new, self.codes.new = self.codes.new, []
        plain, cores, tails, odd = [], [], [], []
        for k, w in enumerate(new):
            core = w.rstrip(TAIL)
            word = core.decode()
            if word.isalpha() and max(word) < "\u0130":
                plain.append(k)
                cores.append(word.lower())
                tails.append(w[len(core) :])
            else:
                odd.append(k)
        size, parts = np.zeros(len(new), np.int64), []
        if odd:
            got = self._encode([new[k].decode() for k in odd])
            n = np.fromiter(map(len, got), np.int64, len(got))
            size[odd] = n
            parts.append((odd, n, np.fromiter((i for g in got for i in g), np.uint32, int(n.sum())), 0))
        if plain:
            plain = np.array(plain)
            got = self.words.encode_batch([cores], is_pretokenized=True, add_special_tokens=False)[0]
            n = np.bincount(np.array(got.word_ids, np.int64), minlength=len(plain))
            size[plain] = n
            parts.append((plain, n, np.array(got.ids, np.uint32), 0))
            kinds = {t: j for j, t in enumerate(dict.fromkeys(tails))}
            kind = np.fromiter(map(kinds.__getitem__, tails), np.int64, len(tails))
            for j, ids in enumerate(self._encode([t.decode() for t in kinds])):
                at = np.flatnonzero(kind == j)
                size[plain[at]] += len(ids)
                parts.append((plain[at], np.full(len(at), len(ids)), np.tile(np.array(ids, np.uint32), len(at)), n[at]))
        start = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.uint32)
        for rows, n, flat, shift in parts:
            ids[np.repeat(start[rows] + shift - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        self.first = np.concatenate([self.first, len(self.ids) + start])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text (null: none), then the id ``end``."""
        if len(self.codes) > self.limit:
            self._clear()
        split = [t.encode().lower().split() if t and "<|" not in t else [] for t in texts]
        coded = [np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)) for words in split]
        if self.codes.new:
            self._learn()
        out = []
        for text, at in zip(texts, coded):
            size = self.size[at]
            total = int(size.sum())
            ids = np.empty(total + 1, np.uint32)
            ids[:total] = self.ids[np.arange(total) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)]
            ids[total] = end
            if text and "<|" in text:
                ids = np.array(self._encode([text])[0] + [end], np.uint32)
            out.append(ids)
        return out


def assign(lengths: list[int], room: list[int], linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset), and (document, start, length) of what found no room.

    A document longer than the largest sequence is first cut at its multiples.
    """
    most = max(room, default=0)
    if not most:
        return [], [(d, 0, n) for d, n in enumerate(lengths) if n]
    items = [(min(most, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, most)]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    left, cost, pieces, over = np.array(room), np.zeros(len(room)), [], []
    size = left.copy()
    free = int(left.sum())
    for n, d, s in items:
        while n and free:
            fits = left >= n
            k = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(left))
            m = min(n, int(left[k]))
            pieces.append((d, s, m, k, int(size[k] - left[k])))
            left[k] -= m
            cost[k] += linear * m + quadratic * m * m
            n, s, free = n - m, s + m, free - m
        if n:
            over.append((d, s, n))
    return pieces, over


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 2, length: int = 4096,
         group: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and checksum, its sequence and
    offset; with ``with_ids`` the ids themselves too.

    Null and empty texts consist of the end id. Repeated rows are packed once each, a null id stays null,
    other columns are not looked at, an empty table gives no pieces. A sequence has ``length`` tokens or
    a power of two. Sequence ids hold the partition's number in their upper bits.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    fields = [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches):
        tokenize = worker_memo(("tokenizer", path), lambda: ChunkTokenizer(path))
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, tokens already packed
        tokens = 0

        def close(last: bool):
            nonlocal held, tokens, number
            room = [length] * (tokens // length) + (powers(tokens % length) if last else [])
            pieces, over = assign([len(ids) - done for _, ids, done in held], room, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[4]))
            rows = []
            for d, s, m, k, at in pieces:
                i, ids, done = held[d]
                part = ids[done + s : done + s + m]
                rows.append((i, done + s, m, zlib.crc32(part.astype("<u4").tobytes()), len(ids), number + k, at) + ((part,) if with_ids else ()))
            number += len(room)
            # What is left of a document need not be its end; it is carried as a slice with its place.
            rest = {}
            for d, s, n in over:
                rest.setdefault(d, []).append((s, n))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema), rest

        def carry(rest):
            nonlocal held, tokens
            kept = []
            for d, parts in rest.items():
                i, ids, done = held[d]
                start = min(s for s, _ in parts)
                assert start + sum(n for _, n in parts) == len(ids) - done, "what is left of a document is its end"
                kept.append((i, ids, done + start))
            held, tokens = kept, sum(len(ids) - done for _, ids, done in kept)

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), tokenize(b.column(1).to_pylist(), end)):
                held.append((i, ids, 0))
                tokens += len(ids)
                if tokens >= group:
                    batch, rest = close(False)
                    carry(rest)
                    yield batch
        if held:
            yield close(True)[0]

    rows = small_batches(docs).select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
