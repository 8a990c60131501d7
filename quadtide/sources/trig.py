"""Text sources: graph statements with embedded statements, one record per Spark row.

Spark splits the files into records and spreads them; a small tokenizer turns one record into
statement rows inside ``mapInArrow``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import count
from operator import itemgetter
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.operators.quads import with_typed
from quadtide.sources import records as records_of
from quadtide.vocab import DEFAULT_GRAPH, GENERATED_AT, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD, iri

# The record reader travels with the job, so executors need not have this package installed. For
# that, code that runs in tasks uses no function of another module of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_SCHEMA = (
    "elem_id string, g string, s string, p string, o string, "
    f"s_t {terms.TRIPLE_TYPE}, o_t {terms.TRIPLE_TYPE}, elem_time string"
)

# Most prefix declarations a dataset may have to be handed to every task.
MAX_PREFIXES = 10_000

_TOKENS = r"""
      (?P<iri><[^<>"{}|^`\s]*+>)
    | (?P<name>(?:[^\W\d_][\w.-]*+)?:(?:[\w:%-]++|\\.|\.(?=[\w:%-]))*+)
    | (?P<word>[A-Za-z]+)
    | (?P<text>\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')
    | (?P<num>[-+]?(?:\d+\.\d*[eE][-+]?\d+|\.?\d+[eE][-+]?\d+|\d*\.\d+|\d+))
    | (?P<mark>[{}\[\]();,.])
    | (?P<type>\^\^)
    | (?P<open><<) | (?P<close>>>)
    | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    | (?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
    | (?P<skip>\#[^\n]*)
"""
_TOKEN = re.compile(rf"\s*(?:{_TOKENS})", re.X | re.S)
# The same for reading a whole record at once, and what is none of them, sign by sign.
_PIECE = re.compile(r"\s*+(" + re.sub(r"\(\?P<\w+>", "(?:", _TOKENS) + r"| \S)", re.X | re.S)
# Kinds by the first sign of a token, and by a token of one sign; names, words and other digits have neither.
_KIND = {"<": "iri", ">": "close", '"': "text", "'": "text", "^": "type", "@": "at", "_": "bnode", "#": "skip"}
_KIND |= dict.fromkeys("+-.0123456789", "num")
_SINGLE = {"#": "skip"} | dict.fromkeys("0123456789", "num") | dict.fromkeys("{}[]();,.", "mark")
_ENDS = (".", "}", "]", "")
_COMMA, _SEMICOLON, _A = ("mark", ","), ("mark", ";"), ("word", "a")
_SPECIAL = re.compile(r"[\\\n\r\t]")
_STRING = iri(XSD + "string")
_TYPED_STRING = f"^^{_STRING}"
_SCHEME = re.compile(r"[A-Za-z][\w+.-]*:")
# A statement written on a line of its own, as ``sinks.write_statements`` does: whole IRIs, and literals without escapes.
_WHOLE = r'<[A-Za-z][\w+.-]*+:[^<>"{}|^`\s\\]*+>'
_VALUE = rf'{_WHOLE}|"[^"\\\n\r\t]*+"(?:\^\^{_WHOLE})?'
_LINE = re.compile(rf"(?:GRAPH ({_WHOLE}) (\{{) )?(?:<< ({_WHOLE}) ({_WHOLE}) ({_VALUE}) >>|({_WHOLE})) ({_WHOLE}) ({_VALUE}) \.( \}})?")
# Terms in whose place records of one shape have others: IRIs but for datatypes, and literals without escapes on one line.
_SLOT = re.compile(r'(<(?<!\^<)[^<>"{}|^`\s\\]*+>|"[^"\\\n\r\t]*+")')
# What makes the reading of a text depend on more than its shape, or hides terms: other literals, escapes, comments,
# declarations, and nodes that belong to the record.
_UNSHAPED = re.compile(r"""["'\\#\[(]|_:|prefix|base""", re.I)
_DATATYPE = re.compile(r'\^\^<[^<>"{}|^`\s\\]*+>')
_MARK = "x-quadtide-slot:"
_MARKED = re.compile(rf'<{_MARK}(?P<iri>\d+)>|"{_MARK}(?P<text>\d+)"(?P<after>.*)', re.S)
# Longest text whose shape is remembered, and how many shapes are.
SHAPED, SHAPES = 1 << 14, 1_000
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _raw(text: str) -> str:
    def one(m):
        body = m.group(1)
        return chr(int(body[1:], 16)) if len(body) > 1 else _PLAIN_ESCAPES.get(body, body)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def _quoted(text: str) -> str:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, shown)
    return f'"{text}"'


def resolved(base: str, text: str) -> str:
    """The term of an IRI as it is written, seen from a base."""
    if not base or ":" in text and _SCHEME.match(text):
        return f"<{text}>"
    if text and text[0] not in "/#?." and "/." not in text and base[-1] == "/":
        return f"<{base}{text}>"
    return f"<{urljoin(base, text)}>"


class RecordReader:
    """Statements of one record; embedded statements are asserted as they are read."""

    def __init__(self, text: str, scope: str, prefixes: dict[str, str], base: str, names: dict[str, str] | None = None,
                 record: str | None = None):
        """``scope`` is where a written blank node label is one node, ``record`` names the unwritten ones."""
        self.tokens = self._scan(text)
        self.at = 0
        self.scope, self.prefixes, self.base = scope, prefixes, base
        # Names written before, already as IRIs; shared by records with the same declarations.
        self.names = {} if names is None else names
        self.record, self.blank = scope if record is None else record, 0
        self.graph = DEFAULT_GRAPH
        self.rows: list[tuple] = []

    @staticmethod
    def _scan(text: str) -> list[tuple[str, str]]:
        tokens, text = [], text.rstrip()
        for piece in _PIECE.findall(text):
            first = piece[0]
            kind = _SINGLE.get(piece) if len(piece) == 1 else _KIND.get(first)
            if kind is None:
                if first == ":" or first.isalpha() and ":" in piece:
                    kind = "name"
                elif first.isalpha() and first.isascii():
                    kind = "word"
                elif first.isdecimal():
                    kind = "num"
                else:
                    RecordReader._refuse(text)
            elif piece == "<<":
                kind = "open"
            if kind != "skip":
                tokens.append((kind, piece))
        tokens.append(("end", ""))
        return tokens

    @staticmethod
    def _refuse(text: str) -> None:
        """Say where the text that is no token begins."""
        end = 0
        for m in iter(_TOKEN.scanner(text).match, None):
            end = m.end()
        raise ValueError(f"unexpected text: {text[end:end + 60]!r}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if token[0] == "end" or mark is not None and token[1] != mark:
            raise ValueError(f"expected {mark or 'a term'!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def skip(self, mark: str) -> bool:
        if self.tokens[self.at] == ("mark", mark):
            self.at += 1
            return True
        return False

    def fresh(self) -> str:
        self.blank += 1
        # No label starts with a dash, so no written one is met.
        return f"_:{self.record}-{self.blank}"

    def emit(self, s, p, o) -> None:
        self.rows.append((self.graph, s[0], p, o[0], s[1], o[1]))

    def resolve(self, text: str) -> str:
        return resolved(self.base, text)

    def read(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix"):
                self.directive(lambda: self.prefixes.__setitem__(self.take()[1][:-1], _raw(self.take()[1][1:-1])))
            elif text.lower() in ("@base", "base"):
                self.directive(lambda: setattr(self, "base", _raw(self.take()[1][1:-1])))
            elif kind == "word" and text.upper() == "GRAPH":
                self.take()
                self.block(self.term()[0])
            elif text == "{":
                self.block(DEFAULT_GRAPH)
            elif not self.skip("."):
                s = self.subject()
                if self.peek()[1] == "{":
                    self.block(s[0])
                else:
                    self.predicates(s)
        # A record is a set of statements: an asserted one may also be written out.
        return list(dict.fromkeys(self.rows))

    def directive(self, store) -> None:
        self.take()
        # The declarations handed in belong to other records too.
        self.prefixes = dict(self.prefixes)
        store()
        self.names = {}
        self.skip(".")

    def block(self, graph: str) -> None:
        self.take("{")
        self.graph = graph
        while not self.skip("}"):
            if not self.skip("."):
                self.predicates(self.subject())
        self.graph = DEFAULT_GRAPH

    def subject(self):
        return self.term()

    def predicates(self, s) -> None:
        tokens, rows, graph = self.tokens, self.rows, self.graph
        while tokens[self.at][1] not in _ENDS:
            p = self.predicate()
            while True:
                o = self.term()
                rows.append((graph, s[0], p, o[0], s[1], o[1]))
                if tokens[self.at] != _COMMA:
                    break
                self.at += 1
            if tokens[self.at] != _SEMICOLON:
                break
            while tokens[self.at] == _SEMICOLON:
                self.at += 1

    def predicate(self) -> str:
        if self.tokens[self.at] == _A:
            self.at += 1
            return RDF_TYPE
        return self.term()[0]

    def term(self) -> tuple[str, tuple | None]:
        kind, text = self.tokens[self.at]
        if kind == "end":
            self.take()
        self.at += 1
        if kind == "iri" or kind == "name":
            known = self.names.get(text)
            if known is not None:
                return known, None
            if kind == "iri":
                known = self.names[text] = self.resolve(_raw(text[1:-1]))
            else:
                prefix, _, local = text.partition(":")
                if prefix not in self.prefixes:
                    raise ValueError(f"prefix {prefix!r} is not declared")
                known = self.names[text] = self.resolve(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
            return known, None
        if kind == "bnode":
            return f"_:{self.scope}{text[2:]}", None
        if kind == "num":
            short = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return f'"{text}"^^<{XSD}{short}>', None
        if kind == "text":
            if text[0] != '"' or text[1:3] == '""' or _SPECIAL.search(text):
                cut = 3 if text[:3] in ('"""', "'''") else 1
                text = _quoted(_raw(text[cut:-cut]))
            return self.literal(text), None
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{XSD}boolean>', None
        if kind == "open":
            s, p, o = self.term(), self.predicate(), self.term()
            self.take(">>")
            self.emit(s, p, o)
            return f"<< {s[0]} {p} {o[0]} >>", (s[0], p, o[0])
        if text == "[":
            node = (self.fresh(), None)
            self.predicates(node)
            self.take("]")
            return node
        if text == "(":
            members = []
            while not self.skip(")"):
                members.append(self.term())
            nodes = [(self.fresh(), None) for _ in members] + [(RDF_NIL, None)]
            for node, member, rest in zip(nodes, members, nodes[1:]):
                self.emit(node, RDF_FIRST, member)
                self.emit(node, RDF_REST, rest)
            return nodes[0]
        raise ValueError(f"unexpected {text!r}")

    def literal(self, quoted: str) -> str:
        kind, text = self.tokens[self.at]
        if kind == "at":
            self.take()
            return f"{quoted}@{text[1:].lower()}"
        if kind == "type":
            self.take()
            datatype = self.term()[0]
            return quoted if datatype == _STRING else f"{quoted}^^{datatype}"
        return quoted


def plain_statement(text: str) -> list[tuple] | None:
    """What a ``RecordReader`` finds in the text of one whole statement; None for all other text."""
    m = _LINE.fullmatch(text)
    if m is None:
        return None
    g, opened, s1, p1, o1, s, p, o, closed = m.groups()
    if (opened is None) != (closed is None) or o.endswith(_TYPED_STRING) or s is None and o1.endswith(_TYPED_STRING):
        return None
    g = DEFAULT_GRAPH if g is None else g
    if s is not None:
        return [(g, s, p, o, None, None)]
    return [(g, s1, p1, o1, None, None), (g, f"<< {s1} {p1} {o1} >>", p, o, (s1, p1, o1), None)]


class Shape:
    """Where the terms of a record go, by the rows of one that has marks in place of its terms."""

    def __init__(self, rows: list[tuple]):
        # Values in the order they are made: fixed ones, IRIs, literals, embedded statements.
        kinds = {"fixed": [], "iri": [], "text": []}
        terms = dict.fromkeys(x for g, s, p, o, s_t, o_t in rows for x in (g, p, *(s_t or (s,)), *(o_t or (o,))))
        for term in terms:
            m = _MARKED.fullmatch(term)
            if _MARK in term and (m is None or m["after"] and _MARK in m["after"]):
                raise ValueError("a mark in a term")
            kinds["fixed" if m is None else "text" if m["iri"] is None else "iri"].append((term, m))
        quoted = list(dict.fromkeys(t for r in rows for t in r[4:] if t is not None))
        self.fixed = [None, *(t for t, _ in kinds["fixed"])]
        self.iris = [int(m["iri"]) for _, m in kinds["iri"]]
        self.texts = [(int(m["text"]), m["after"]) for _, m in kinds["text"]]
        at = {t: i for i, t in enumerate([None, *(t for k in ("fixed", "iri", "text") for t, _ in kinds[k])])}
        n = len(at)
        self.quoted = [tuple(at[x] for x in t) for t in quoted]
        for i, t in enumerate(quoted):
            at[t], at[f"<< {t[0]} {t[1]} {t[2]} >>"] = n + 2 * i, n + 2 * i + 1
        self.rows = [itemgetter(*(at[x] for x in row)) for row in rows]

    def fill(self, values: list[str], base: str) -> list[tuple]:
        v = self.fixed + [resolved(base, values[i][1:-1]) for i in self.iris] + [values[i] + after for i, after in self.texts]
        for s, p, o in self.quoted:
            s, p, o = v[s], v[p], v[o]
            v += (s, p, o), f"<< {s} {p} {o} >>"
        return list(dict.fromkeys([row(v) for row in self.rows]))


class Shapes:
    """Reads records by their shape, the text that is left around their IRIs and plain literals.

    Records of one shape have their terms in the same places of the same statements. These are found once, by a
    ``RecordReader``; for further records of the shape only terms are put into their places.
    """

    def __init__(self, prefixes: dict[str, str], base: str):
        self.prefixes, self.base = prefixes, base
        self.known: dict[tuple[str, ...], Shape | bool] = {}

    def read(self, text: str) -> list[tuple] | None:
        """What a ``RecordReader`` finds; None for texts that are left to it."""
        if len(text) > SHAPED:
            return None
        parts = _SLOT.split(text)
        key = tuple(parts[::2])
        shape = self.known.get(key)
        if shape is None:
            if len(self.known) >= SHAPES:
                self.known.clear()
            # True: met once.
            shape = self.known[key] = True
        elif shape is True:
            shape = self.known[key] = self.learn(parts)
        return shape.fill(parts[1::2], self.base) if isinstance(shape, Shape) else None

    def learn(self, parts: list[str]) -> Shape | bool:
        around = parts[::2]
        # Quotes of literals that touch would be read as others.
        if not all(around[1:-1]) or any(_MARK in x or _UNSHAPED.search(_DATATYPE.sub("", x)) for x in around):
            return False
        marked = list(parts)
        for i, value in enumerate(parts[1::2]):
            marked[2 * i + 1] = f"{value[0]}{_MARK}{i}{value[-1]}"
        try:
            return Shape(RecordReader("".join(marked), "", self.prefixes, self.base).read())
        except (ValueError, KeyError):
            return False


def _known(record: dict) -> dict[str, str]:
    """Declarations that hold for a record: the last one above it in its file, else the first one of
    the file, else the dataset's."""
    known = {d["name"]: d["target"] for d in record["common"] or ()}
    here, met = (record["block"], record["rec"]), set()
    for d in record["own"] or ():
        if d["name"] not in met or (d["block"], d["rec"]) < here:
            known[d["name"]] = d["target"]
        met.add(d["name"])
    return known


def parse_records(records: DataFrame, prefixes: dict[str, str], base: str = "") -> DataFrame:
    """Statement rows of ``records``: value, file, block, optionally a ``scope`` and declarations.

    A record is numbered in its split, which one task reads from top to bottom, so equal records stay
    distinct and a repeated task gives the same numbers. A blank node without a label belongs to its
    record, a labelled one to ``scope``, by default the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([(n, pa.string()) for n in "spo"])
        types = [pa.string()] * 5 + [part, part, pa.string()]
        fields = ["elem_id", "g", "s", "p", "o", "s_t", "o_t", "elem_time"]
        shared: dict[str, str] = {}

        def nested(terms: list[tuple | None]) -> pa.Array:
            found = [t for t in terms if t is not None]
            if not found:
                return pa.nulls(len(terms), part)
            whole, number = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], "spo"), count()
            return whole.take(pa.array([None if t is None else next(number) for t in terms], pa.int64()))

        numbers: dict[tuple, int] = {}
        given = dict(prefixes)
        given_base = given.pop("@base", base)
        shapes = Shapes(given, given_base)
        for batch in batches:
            if len(shared) > 50_000:
                shared.clear()
            rows = []
            have, missing = set(batch.schema.names), [None] * batch.num_rows
            local = "common" in have
            column = lambda n: batch.column(n).to_pylist() if n in have else missing
            wanted = ("value", "file", "block", "elem_id", "scope", "rec", "common", "own")
            for value, file, block, element, scope, rec, common, own in zip(*map(column, wanted)):
                if element is None:
                    numbers[file, block] = number = numbers.get((file, block), 0) + 1
                    element = f"{file}-{block}-{number}"
                found = plain_statement(value)
                if found is None and not local:
                    found = shapes.read(value)
                if found is None:
                    known, start, names = given, given_base, shared
                    if local:
                        known, names = _known({"common": common, "own": own, "block": block, "rec": rec}), {}
                        start = known.pop("@base", base)
                    found = RecordReader(value, scope or f"{element}--", known, start, names, element).read()
                time = None
                for r in found:
                    if r[0] == DEFAULT_GRAPH and r[2] == GENERATED_AT and (time is None or r[3] > time):
                        time = r[3]
                rows.extend([(element, *r, time) for r in found])
            columns = list(zip(*rows)) if rows else [()] * len(types)
            arrays = [nested(c) if t is part else pa.array(c, type=t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return with_typed(records.mapInArrow(run, ROW_SCHEMA))


_DECLARING = r"(?i)(prefix|base)\b"
_DIRECTIVE = r"(?i)@?(?:prefix\s+([^\s:]*:)|(base))\s*<([^>]*)>"


def declared_prefixes(records: DataFrame) -> DataFrame:
    """(path, file, block, rec, i, name, target) of every prefix and base declaration, in this order within a
    file; the base is named ``@base``."""
    found = records.where(F.col("value").rlike(r"(?im)^\s*@?(prefix|base)\b"))
    pairs = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(_DIRECTIVE), 1).alias("n"),
        F.regexp_extract_all("value", F.lit(_DIRECTIVE), 3).alias("v"),
    )
    one = found.select("path", "file", "block", "rec", F.posexplode(pairs).alias("i", "x"))
    name = F.when(F.col("x.n") == "", "@base").otherwise(F.regexp_replace("x.n", ":$", ""))
    return one.select("path", "file", "block", "rec", "i", name.alias("name"), F.col("x.v").alias("target"))


def _with_prefixes(records: DataFrame, prefixes: dict[str, str] | None, declaring: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Records and the declarations that hold for them. ``declaring``: records that hold all declarations.

    Usually all files agree and the declarations go to the tasks as a small map. Where a name has
    several targets, or there are very many names, records get the declarations of their file by a
    join; for a name its file does not declare, the first file by name that does counts.
    """
    declared, records = declared_prefixes(records), records.drop("path")
    if prefixes is not None:
        return records, prefixes
    look = declared if declaring is None else declared_prefixes(declaring)
    rows = look.select("name", "target").distinct().limit(MAX_PREFIXES + 1).collect()
    if len({r["name"] for r in rows}) == len(rows) <= MAX_PREFIXES:
        return records, {r["name"]: r["target"] for r in rows}
    at = F.struct("block", "rec", "i", "name", "target")
    own = declared.groupBy("file").agg(F.sort_array(F.collect_list(at)).alias("own"))
    first = declared.groupBy("name").agg(F.min_by("target", F.struct("path", "block", "rec", "i")).alias("target"))
    common = first.agg(F.collect_list(F.struct("name", "target")).alias("common"))
    return records.join(own, "file", "left").crossJoin(common), {}


def _with_source(df: DataFrame) -> DataFrame:
    """Records with their file (a short name) and split; declarations stay in and yield no rows."""
    path = F.col("_metadata.file_path")
    rows = df.select(
        "value", path.alias("path"), F.concat(F.lit("f"), F.substring(F.md5(path), 1, 12)).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return rows.where(F.trim("value") != "")


def _numbered(records: DataFrame) -> DataFrame:
    """Records of a table with their place in the file, and with an identity that a join keeps."""
    return records.withColumn("rec", F.monotonically_increasing_id()).withColumn("elem_id", F.concat("file", F.lit("-"), "rec"))


def read_elements(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, base: str = "") -> DataFrame:
    """Stream elements from text files with one element per line (first line: declarations).

    An element is read on its own, so a blank node label is one node within it only.
    Given ``prefixes``, the files are read once; without, a first pass looks for the declarations.
    """
    records, known = _with_prefixes(_numbered(_with_source(spark.read.text(path))), prefixes)
    return _timed(parse_records(records, known, base))


def _timed(quads: DataFrame) -> DataFrame:
    """Event time of an element; one that states no readable time belongs to the epoch."""
    time = F.coalesce(terms.moment(F.col("elem_time")), F.lit(0).cast("timestamp"))
    return quads.withColumn("elem_ts", time).drop("elem_time")


def stream_elements(spark: SparkSession, path: str, prefixes: dict[str, str], base: str = "") -> DataFrame:
    """The same from a growing folder; declarations are given, as a stream has no first pass."""
    return _timed(parse_records(_with_source(spark.readStream.text(path)).drop("path"), prefixes, base))


def read_dataset(
    spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, base: str = "", unit: str = "statement",
    labels: str = "file",
) -> DataFrame:
    """Static statements.

    ``unit`` is what one task reads at a time: ``statement`` (over any number of lines, in graph blocks and
    files of any size), ``line`` (statements are known to end where the line ends: one pass less), or
    ``file`` (single files are small). A blank node label is one node in its ``file``, or in the whole
    ``dataset`` for a folder that was written as one; one without a label belongs to its record.
    """
    declaring = None
    if unit == "statement":
        found = records_of.cut(spark, path)
        if prefixes is None:
            # Only files with such a word in them are cut to look for declarations.
            declaring = _numbered(records_of.cut(spark, path, _DECLARING))
    else:
        found = _with_source(spark.read.text(path, **{"line": {}, "file": {"wholetext": True}}[unit]))
    records = _numbered(found)
    whole = F.concat(F.lit("d"), F.substring(F.md5(F.lit(path)), 1, 12))
    records = records.withColumn("scope", whole if labels == "dataset" else F.col("file"))
    if unit == "file" and prefixes is None:
        prefixes = {}
    records, known = _with_prefixes(records, prefixes, declaring)
    return parse_records(records, known, base).drop("elem_id", "elem_time").dropDuplicates(["g", "s", "p", "o"])


def load_into(quads: DataFrame, loaded: DataFrame, graph: str) -> DataFrame:
    """LOAD ... INTO GRAPH: every loaded statement, and what it embeds, goes to one graph."""
    from quadtide.operators.quads import KEY, TYPED, assert_embedded, distinct_quads

    cols = [*KEY, *TYPED]
    placed = loaded.withColumn("g", F.lit(graph))
    return distinct_quads(with_typed(quads).select(*cols).unionByName(assert_embedded(placed).select(*cols)))
