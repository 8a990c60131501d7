"""Spelling variants by PartEnum signatures over letter multisets.

A word's letters, each with the number of its occurrence, are a binary vector; one edit changes at most
two of its places. The places are dealt into ``parts`` parts (a hash, so no part holds only rare letters).
Two vectors at a Hamming distance of at most two agree on all but two parts, so their projections on some
``parts - 2`` parts are equal: every such subset, enumerated, gives an exact signature, and near words
share one. Words are joined on equal signatures and verified by their edit distance.

A projection of letters forgets their order and would fill its buckets with anagrams. One edit also
leaves the first or the last half of the shorter word as it is, so each signature is cut by the half it
comes with: buckets shrink from thousands of words to a few, and no near pair is lost.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import column, saved, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Spelling:
    """Words have at least ``length`` code points and occur ``support`` times. A word's form is its near
    word of largest count, if that is at least ``ratio`` times its own. One of ``noise`` runs loses a
    code point (0: none). Letter vectors are cut into ``parts`` parts."""

    length: int = 7
    support: int = 2
    ratio: int = 10
    noise: int = 31
    parts: int = 3
    run: str = "[a-zÀ-ÿ]"


def noisy(run: str, doc: str, noise: int) -> str:
    """The run of a document, without one code point where its checksum says so."""
    h = zlib.crc32(f"{doc}:{run}".encode()) if noise else 1
    if noise and h % noise == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def counts(docs: DataFrame, id_col: str, text_col: str, conf: Spelling) -> DataFrame:
    """(``word``, ``n``) of all documents, added up in each task before the shuffle."""
    pattern, limit = conf.run + "{%d,}" % conf.length, 1 << 20

    def count(batches):
        runs, total = regex.compile(pattern), Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # bytes.lower changes A-Z only.
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = noisy(run, "" if doc is None else str(doc), conf.noise)
                    if len(word) >= conf.length:
                        total[word] += n
            if len(total) > limit:
                yield emit()
                total.clear()
        yield emit()

    rows = small_batches(docs).select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= conf.support)


def part_of(place: tuple[str, int], parts: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{place[0]}{place[1]}".encode()) % parts


def signatures(word: str, parts: int) -> list[str]:
    """The projections of a word's letter multiset on every subset of all but two parts."""
    seen, held = Counter(), [[] for _ in range(parts)]
    for c in sorted(word):
        held[part_of((c, seen[c]), parts)].append(c)
        seen[c] += 1
    return ["|".join(["".join(held[p]) for p in subset] + [str(i)]) for i, subset in enumerate(combinations(range(parts), parts - 2))]


def halves(word: str) -> list[str]:
    """The halves a near word may share: for a shorter word of this length, and of one less."""
    out = []
    for size in (len(word), len(word) - 1):
        cut = size // 2
        out += [f"{size}<{word[:cut]}", f"{size}>{word[len(word) - (size - cut):]}"]
    return out


def keyed(words: DataFrame, conf: Spelling) -> DataFrame:
    """(``key``, ``word``): a row for each signature and half of each word."""

    def cut(batches):
        for b in batches:
            keys, at = [], []
            for i, word in enumerate(b.column(0).to_pylist()):
                own = {xxhash.xxh3_64_intdigest(f"{s}#{h}".encode()) for s in signatures(word, conf.parts) for h in halves(word)}
                keys += own
                at += [i] * len(own)
            keys = pa.array(keys, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([keys, b.column(0).take(pa.array(at, pa.int64()))], ["key", "word"])

    return words.select("word").mapInArrow(cut, "key long, word string")


def near_pairs(words: DataFrame, conf: Spelling) -> DataFrame:
    """(``a``, ``b``) with a < b at an edit distance of one, once each."""
    keys = keyed(words, conf)
    both = keys.select("key", F.col("word").alias("a")).join(keys.select("key", F.col("word").alias("b")), "key")
    both = both.where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return both.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): forms followed to the last. Counts rise by the ratio at each step, so there
    are few, and each round doubles the steps taken."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: Spelling = Spelling()) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are runs of letters, A-Z lower-cased, near if they differ by one inserted, deleted or replaced
    code point. The near word of largest ``n``, ties to the smallest in code-point order, is the form if
    its ``n`` is at least ``ratio`` times the word's, else null; ``root`` is the last form reached, the
    word itself if it has none. Null and empty texts have no words; a null id counts as an empty one; each
    row of a repeated document counts; texts and runs of any length are read whole; other columns are not
    looked at; an empty table gives no rows.
    """
    words = saved(counts(docs, id_col, text_col, conf), "words")
    pairs = saved(near_pairs(words, conf), "near")
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    each = each.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    good = -F.col("best.m") >= F.col("n") * conf.ratio
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    found = saved(found, "forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
