"""Cutting files of statements into records, whatever lines they span, in parallel.

Whether a dot ends a statement depends on all text before it: it may stand in a long literal, a comment
or a graph block. So each split of a file is first read once for every state it may start in (outside or
in one of the two kinds of long literals, outside or in a block) and yields the state it ends in. These
transitions are composed over the splits of a file in order, which gives each split its true start, and
a second pass cuts the records. What is open at the end of a split is joined with what ends it in the
next ones. A graph block is cut at its dots too: each piece gets the block's graph written around it, so
a block may be of any size. Files of one split need no first pass, and nothing of them is joined.

Tasks read the lines of a batch as one text for each split in it, not one by one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where a text position is: outside, or in a long literal of either kind.
OUT, DOUBLE, SINGLE = 0, 1, 2
_MARK = {DOUBLE: '"""', SINGLE: "'''"}
_CLOSE = {DOUBLE: re.compile(r'\\.|"""', re.S), SINGLE: re.compile(r"\\.|'''", re.S)}
# What can hide a sign, and the signs: a dot only where it ends a token.
_SIGN = re.compile(r"""\"\"\"|'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|<[^<>"{}|^`\\\s]*>|\#[^\n\r]*|[{}]|\.(?=[\s}\#]|$)""")
#: A graph's name before a block is kept up to this length; longer text before a brace is an error.
HEADER = 1 << 16
#: Names of files that are written into a filter.
NAMED = 1_000
#: States of splits that are sent to the tasks, some hundred bytes each; beyond, splits are joined by a shuffle.
SENT = 50_000

_STATE = "start int, end int, header string, part boolean, fresh boolean, pending string"
_PIECE = "file string, path string, block long, key long, kind string, header string, value string"


class Cutter:
    """Follows text from a state and hands out the records that end in it."""

    def __init__(self, mode: int, depth: int, header: str | None, known: bool = True):
        self.mode, self.depth, self.header = mode, depth, header
        # Text since the last cut; ``fresh`` once that cut is in this split.
        self.pending: list[str] = []
        self.size, self.fresh, self.part = 0, False, False
        self.keep = known

    def _hold(self, text: str) -> None:
        # Whoever only looks for the state needs no more text than a graph's name can have.
        self.size += len(text)
        if self.keep or self.size <= HEADER:
            self.pending.append(text)

    def state(self) -> tuple:
        """All that the further course depends on."""
        return self.mode, self.depth, self.header, self.size, self.fresh, self.part, "".join(self.pending)

    def _cut(self) -> str:
        text = "".join(self.pending)
        self.pending, self.size = [], 0
        return text

    def feed(self, line: str) -> Iterator[tuple[str, str | None, str, bool]]:
        """(kind, graph, text, whether it began in this split) of what ends in these whole lines."""
        at, last = 0, 0
        while at <= len(line):
            if self.mode != OUT:
                m = next((m for m in _CLOSE[self.mode].finditer(line, at) if len(m[0]) == 3), None)
                if m is None:
                    break
                self.mode, at = OUT, m.end()
                continue
            m = _SIGN.search(line, at)
            if m is None:
                break
            at, sign = m.end(), m[0]
            if sign in ('"""', "'''"):
                self.mode = DOUBLE if sign[0] == '"' else SINGLE
            elif sign == "." or sign == "}" and self.depth or sign == "{" and not self.depth:
                end = at if sign == "." else m.start()
                self._hold(line[last:end])
                last, fresh = at, self.fresh
                long = not self.keep and self.size > HEADER
                text = self._cut()
                if sign == "{":
                    self.header, self.depth, self.part = None if long else text, 1, long or not fresh
                    yield "header", None, text, fresh
                else:
                    yield "record", self.header if self.depth else None, text, fresh
                    if sign == "}":
                        self.depth, self.header, self.part = 0, None, False
                self.fresh = True
        self._hold(line[last:])


def wrapped(header: str | None, text: str) -> str | None:
    """The text of a record with its graph around it; None if there is nothing in it."""
    if not text.strip():
        return None
    return text if header is None else f"{header} {{ {text} }}"


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """For each split in a batch of lines: the number of its first row, and its lines as one text."""
    n = batch.num_rows
    if not n:
        return
    ends = [0, n]
    for name in ("file", "block"):
        column = batch.column(name)
        ends += [i + 1 for i in pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1))).to_pylist()]
    ends = sorted(set(ends))
    value = batch.column("value")
    for first, end in zip(ends, ends[1:]):
        yield first, "\n".join(value.slice(first, end - first).to_pylist()) + "\n"


def transitions(lines: DataFrame) -> DataFrame:
    """For each split and start state, coded as mode * 2 + depth: the state at its end, the graph it is in
    then, and the text since the last cut. Starts that have come to the same state are followed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutters = None, []

        def out():
            rows = []
            for start, c in enumerate(cutters):
                pending = "".join(c.pending) if c.size <= HEADER else None
                rows.append((*now, start, c.mode * 2 + c.depth, c.header if c.depth else None, c.part, c.fresh, pending))
            names = ["file", "block", "start", "end", "header", "part", "fresh", "pending"]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for at, text in texts(b):
                split = b.column("file")[at].as_py(), b.column("block")[at].as_py()
                if split != now:
                    if now:
                        yield out()
                    now, cutters = split, [Cutter(s // 2, s % 2, None, known=False) for s in range(6)]
                for c in {id(c): c for c in cutters}.values():
                    if c.mode != OUT and _MARK[c.mode] not in text:
                        c.size += len(text)
                        continue
                    for _ in c.feed(text):
                        pass
                same: dict[tuple, Cutter] = {}
                cutters = [same.setdefault(c.state(), c) for c in cutters]
        if now:
            yield out()

    return lines.mapInArrow(run, "file string, block long, " + _STATE)


def starts(found: DataFrame) -> DataFrame:
    """(``file``, ``block``, ``state``, ``graph``, ``before``, ``key``): how each split starts, the text since
    the last cut where that may be a graph's name, and in which split the record began that is open there.
    A file's splits are composed in order, some hundred bytes for each."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, state, graph, pending = [], 0, None, ""
        table = {(r.block, r.start): r for r in rows.itertuples()}
        blocks = sorted(set(rows["block"]))
        key = blocks[0]
        for block in blocks:
            out.append((rows["file"].iloc[0], block, state, graph, None if state % 2 else pending, key))
            r = table[block, state]
            if r.end % 2 == 0:
                graph = None
            elif r.header is not None or r.part:
                if r.header is None or r.part and pending is None:
                    raise ValueError(f"no name of a graph, but more than {HEADER} characters before its block")
                graph = pending + r.header if r.part else r.header
            if r.fresh:
                key, pending = block, r.pending
            else:
                pending = None if pending is None or r.pending is None else pending + r.pending
            state = r.end
        return pd.DataFrame(out, columns=["file", "block", "state", "graph", "before", "key"])

    return found.groupBy("file").applyInPandas(fold, "file string, block long, state int, graph string, before string, key long")


def pieces(lines: DataFrame) -> DataFrame:
    """The records that end in each split, whole ones and what has to be joined: the tail of a split
    (``key`` is its block) and the text that ends or continues a record of an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, rows, alone = None, None, [], False

        def batch():
            names = [f.split()[0] for f in _PIECE.split(", ")]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names)
            rows.clear()
            return done

        def tail():
            # Text before the first cut goes on with the record that was open, else a new one is open.
            file, path, block, key = now
            if alone:
                if whole := wrapped(cutter.header, cutter._cut()):
                    rows.append((file, path, block, block, "whole", None, whole))
                return
            rows.append((file, path, block, block if cutter.fresh else key, "open", cutter.header, cutter._cut()))

        columns = ("file", "path", "block", "state", "graph", "before", "key")
        for b in batches:
            for at, value in texts(b):
                file, path, block, state, graph, before, key = (b.column(n)[at].as_py() for n in columns)
                if now is None or (file, block) != (now[0], now[2]):
                    if now:
                        tail()
                    # Without a state it is the only split of its file.
                    alone = state is None
                    now = (file, path, block, block if key is None else key)
                    cutter = Cutter((state or 0) // 2, (state or 0) % 2, graph)
                    # Nothing is open where a file starts.
                    cutter.fresh = now[3] == block
                for kind, header, text, fresh in cutter.feed(value):
                    if kind == "header" and not fresh:
                        cutter.header = before + text
                    if not fresh:
                        rows.append((file, path, block, now[3], kind, header, text))
                    elif kind == "record" and (whole := wrapped(header, text)):
                        rows.append((file, path, block, block, "whole", None, whole))
            if rows:
                yield batch()
        if now:
            tail()
        if rows:
            yield batch()

    return lines.mapInArrow(run, _PIECE)


def joined(parts: DataFrame) -> DataFrame:
    """The records that lie in several splits, in the order of their parts; a graph's name is none."""
    at = F.sort_array(F.collect_list(F.struct("block", "kind", "header", "value")))
    whole = parts.groupBy("file", "path", "key").agg(at.alias("at"))
    text = F.array_join(F.transform("at", lambda p: p["value"]), "")
    graph = F.col("at")[0]["header"]
    whole = whole.where(~F.exists("at", lambda p: p["kind"] == "header") & (F.trim(F.regexp_replace(text, r"\s", "")) != ""))
    value = F.when(graph.isNull(), text).otherwise(F.concat(graph, F.lit(" { "), text, F.lit(" }")))
    return whole.select(value.alias("value"), "path", "file", F.col("key").alias("block"))


def cut(spark: SparkSession, path: str, holding: str | None = None) -> DataFrame:
    """``value``, ``path``, ``file``, ``block`` of the records of text files: single statements, each in its
    graph, and declarations. Records of a split come in order, one that goes on in the next split last.

    ``holding`` leaves out files without a line that matches this pattern, if few files have one."""
    source, meta = spark.read.option("lineSep", "\n").text(path), F.col("_metadata")
    name = F.concat(F.lit("f"), F.substring(F.md5(meta["file_path"]), 1, 12))
    split = (meta["file_block_start"] > 0) | (meta["file_block_length"] < meta["file_size"])
    lines = source.select("value", meta["file_path"].alias("path"), name.alias("file"), meta["file_block_start"].alias("block"), split.alias("split"))
    if holding is not None:
        files = [r["file"] for r in lines.where(F.col("value").rlike(holding)).select("file").distinct().limit(NAMED + 1).collect()]
        lines = lines.where(F.col("file").isin(files)) if len(files) <= NAMED else lines
    known = starts(transitions(lines.where("split").select("value", "file", "block"))).persist()
    n = known.count()
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    if n <= SENT:
        placed = lines.join(F.broadcast(known), ["file", "block"], "left")
    else:
        placed = lines.join(known, ["file", "block"], "left").sortWithinPartitions("file", "block", "line")
    wanted = ["value", "file", "path", "block", "state", "graph", "before", "key"]
    whole = pieces(placed.select(*wanted)).where("kind = 'whole'").select("value", "path", "file", "block")
    if n == 0:
        return whole
    return whole.unionByName(joined(pieces(placed.where("split").select(*wanted)).where("kind != 'whole'")))
