"""Canonical term text, and its parts as columns.

A term is one string: ``<iri>``, ``_:label``, ``"lex"``, ``"lex"@tag``, ``"lex"^^<datatype>`` or
``<< s p o >>``. Joins compare this text; expressions compare the typed parts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadtide.vocab import LANG_STRING, XSD

# Functions that run in tasks travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The numeric datatypes of XML Schema.
NUMERIC_TYPES = tuple(
    XSD + n
    for n in (
        "integer", "decimal", "double", "float", "byte", "short", "int", "long", "unsignedByte",
        "unsignedShort", "unsignedInt", "unsignedLong", "nonNegativeInteger", "positiveInteger",
        "nonPositiveInteger", "negativeInteger",
    )
)

TRIPLE_TYPE = "struct<s:string,p:string,o:string>"
STEPS_TYPE = "array<struct<p:string,o:string>>"
CHAIN_TYPE = f"struct<root:string,steps:{STEPS_TYPE}>"


def escape(text: Column) -> Column:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescape(text: Column) -> Column:
    def plain(piece: Column) -> Column:
        for shown, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            piece = F.replace(piece, F.lit(shown), F.lit(raw))
        return piece

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def bnode(label: Column) -> Column:
    return F.concat(F.lit("_:"), label)


def string(text: Column) -> Column:
    return F.concat(F.lit('"'), escape(text), F.lit('"'))


def typed(lexical: Column, datatype: str) -> Column:
    if datatype == XSD + "string":
        return string(lexical)
    return F.concat(F.lit('"'), escape(lexical), F.lit(f'"^^<{datatype}>'))


def typed_by(lexical: Column, datatype: Column) -> Column:
    """STRDT with the datatype IRI as data."""
    return F.when(datatype == XSD + "string", string(lexical)).otherwise(
        F.concat(string(lexical), F.lit("^^<"), datatype, F.lit(">"))
    )


def tagged(lexical: Column, tag: Column) -> Column:
    return F.concat(string(lexical), F.lit("@"), F.lower(tag))


def number(value: Column, datatype: str = XSD + "double") -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{datatype}>'))


def date_time(value: Column) -> Column:
    return F.concat(
        F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(f'Z"^^<{XSD}dateTime>')
    )


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


def kind(term: Column) -> Column:
    return (
        F.when(F.startswith(term, F.lit("<< ")), "triple")
        .when(F.startswith(term, F.lit("<")), "iri")
        .when(F.startswith(term, F.lit("_:")), "bnode")
        .when(F.startswith(term, F.lit('"')), "literal")
    )


def is_iri(term: Column) -> Column:
    return F.startswith(term, F.lit("<")) & ~F.startswith(term, F.lit("<< "))


def is_blank(term: Column) -> Column:
    return F.startswith(term, F.lit("_:"))


def is_literal(term: Column) -> Column:
    return F.startswith(term, F.lit('"'))


def is_triple(term: Column) -> Column:
    return F.startswith(term, F.lit("<< "))


def is_numeric(term: Column) -> Column:
    return num(term).isNotNull()


# The closing quote of a literal is the last one: neither a tag nor a datatype IRI holds a quote.
_BODY = r'(?s)^"(.*)"[^"]*$'
_TAG = r'(?s)^".*"@([A-Za-z0-9-]+)$'
_TYPE = r'(?s)^".*"\^\^<([^<>"]*)>$'


def lex(term: Column) -> Column:
    """STR: lexical form of a literal, text of an IRI; NULL for other terms."""
    return F.when(is_literal(term), unescape(F.regexp_extract(term, _BODY, 1))).when(
        is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2)
    )


def lang(term: Column) -> Column:
    """LANG: the tag, empty for literals without one; NULL for other terms."""
    return F.when(is_literal(term), F.regexp_extract(term, _TAG, 1))


def datatype(term: Column) -> Column:
    found = F.regexp_extract(term, _TYPE, 1)
    return F.when(
        is_literal(term),
        F.when(found != "", found).when(F.regexp_extract(term, _TAG, 1) != "", LANG_STRING).otherwise(XSD + "string"),
    )


def lang_matches(tag: Column, wanted: Column | str) -> Column:
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    t, w = F.lower(tag), F.lower(wanted)
    return F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-"))))


def _body_of(term: Column, *types: str) -> Column:
    """What is between the quotes of a literal of one of these types, which stands behind its last sign of a type."""
    shown = F.substring_index(term, '"^^', -1)
    body = F.substring(term, F.lit(2), F.length(term) - F.length(shown) - 4)
    return F.when(is_literal(term) & shown.isin(*[f"<{t}>" for t in types]), body)


def num(term: Column) -> Column:
    return _body_of(term, *NUMERIC_TYPES).try_cast("double")


def moment(term: Column) -> Column:
    return _body_of(term, XSD + "dateTime", XSD + "date").try_cast("timestamp")


def boolean(term: Column) -> Column:
    body = _body_of(term, XSD + "boolean")
    return F.when(body.isin("true", "1"), True).when(body.isin("false", "0"), False)


def ebv(term: Column) -> Column:
    """Effective boolean value of a term; NULL is an error."""
    return F.coalesce(
        boolean(term),
        (num(term) != 0) & ~F.isnan(num(term)),
        F.when(datatype(term).isin(XSD + "string", LANG_STRING), lex(term) != ""),
    )


def order_rank(term: Column) -> Column:
    """Unbound before blank nodes before IRIs before literals before embedded statements."""
    return (
        F.when(term.isNull(), 0).when(is_blank(term), 1).when(is_triple(term), 4).when(is_iri(term), 2).otherwise(3)
    )


def order_key(term: Column) -> Column:
    """Sort struct: term class, then value for numbers and times, then text."""
    return F.struct(
        order_rank(term).alias("rank"), num(term).alias("num"), moment(term).alias("ts"), term.alias("text")
    )


# The pieces of a term's text: the signs around embedded statements, literals, and all others, which hold no space.
_TOKEN = r'<<|>>|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?|\S+'


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def embedded(term: Column) -> Column:
    """All embedded statements in a term, itself if it is one, at any depth; NULL for other terms."""
    every = lambda c: F.transform(c["steps"], lambda _, n: chain_term(c["root"], c["steps"], n + 1))
    found = embedded_chains(F.lit(None).cast("string"), term)["others"]
    return F.when(is_triple(term), F.flatten(F.transform(found, every)))


def chain_term(root: Column, steps: Column, n: Column) -> Column:
    """The statement that the first ``n`` steps of a chain make, the root where that is 0."""
    around = F.transform(F.slice(steps, F.lit(1), n), lambda x: F.concat(F.lit(" "), x["p"], F.lit(" "), x["o"], F.lit(" >>")))
    return F.when(n == 0, root).otherwise(F.concat(F.repeat(F.lit("<< "), n), root, F.array_join(around, "")))


def embedded_chains(s: Column, o: Column) -> Column:
    """Embedded statements of a subject and an object, each in one chain with those that stand in its own subject.

    A chain is the innermost subject, ``root``, and the ``steps`` (predicate, object) of the statements around it,
    from the inside out. ``about`` is the chain that makes the subject; it is NULL where the subject embeds nothing
    or is not written as its chain is, and then its chain is one of the ``others``.

    Signs are read from left to right: a closing one ends the statement of the last open one, which is put
    together there and is a part of the one around it.
    """
    tokens = re.compile(_TOKEN, re.ASCII).findall

    # In tasks, a chain is its root and the predicates and objects of its steps.
    def text_of(root: str, predicates: list[str], objects: list[str]) -> str:
        return "<< " * len(objects) + root + "".join(f" {p} {o} >>" for p, o in zip(predicates, objects))

    def chains(text: str) -> tuple[tuple | None, list[tuple]]:
        """The chain that makes the text, and the others in it."""
        # Without a literal every space parts two pieces.
        pieces = tokens(text) if '"' in text else text.split(" ")
        depth = pieces.count("<<")
        if len(pieces) == 4 * depth + 1 and pieces[:depth].count("<<") == depth == pieces[depth + 3 :: 3].count(">>") == pieces.count(">>"):
            # Only subjects embed something.
            one = pieces[depth], pieces[depth + 1 :: 3], pieces[depth + 2 :: 3]
            return (one, []) if text_of(*one) == text else (None, [one])
        opened: list[list] = []
        outer, others = [], []
        for piece in pieces:
            if piece == "<<":
                opened.append([])
                continue
            if piece == ">>":
                if not opened:
                    continue
                first, *rest = opened.pop() or [""]
                others.extend(x for x in rest if type(x) is tuple)
                rest = [text_of(*x) if type(x) is tuple else x for x in rest]
                piece = first if type(first) is tuple else (first, [], [])
                piece[1].append(rest[0] if rest else "")
                piece[2].append(" ".join(rest[1:]))
                if not opened:
                    outer.append(piece)
            if opened:
                opened[-1].append(piece)
        others.extend(x for terms in opened for x in terms if type(x) is tuple)
        one = outer.pop() if len(outer) == 1 and text_of(*outer[0]) == text else None
        return one, outer + others

    def array_of(found: list[tuple | None]) -> pa.StructArray:
        ends, predicates, objects = [0], [], []
        for chain in found:
            if chain:
                predicates += chain[1]
                objects += chain[2]
            ends.append(len(objects))
        steps = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (predicates, objects)], list("po"))
        roots = pa.array([chain and chain[0] for chain in found], pa.string())
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        return pa.StructArray.from_arrays([roots, listed], ["root", "steps"], mask=pa.array([c is None for c in found], pa.bool_()))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for subjects, objects in batches:
            about, ends, others = [], [0], []
            for s, o in zip(subjects.to_pylist(), objects.to_pylist()):
                one, more = (None, []) if s is None else chains(s)
                about.append(one)
                others += more
                if o is not None:
                    one, more = chains(o)
                    others += more if one is None else [one, *more]
                ends.append(len(others))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), array_of(others))
            yield pa.StructArray.from_arrays([array_of(about), listed], ["about", "others"])

    # Annotations are text in this module, and the kind of function is read from them.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    read = F.arrow_udf(run, f"struct<about:{CHAIN_TYPE},others:array<{CHAIN_TYPE}>>")
    return read(*[F.when(is_triple(x), x) for x in (s, o)])


def decode_triple(term: Column) -> Column:
    """Subject, predicate and object of an embedded statement, nested to any depth; NULL for other terms."""

    def nested(body: Column) -> Column:
        """The embedded statement at the start: the tokens up to where as many have closed as opened."""

        def step(acc: Column, token: Column) -> Column:
            depth = acc["depth"] + F.when(token == "<<", 1).when(token == ">>", -1).otherwise(0)
            return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth == 0).alias("done")))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        return _once(_tokens(body), lambda tokens: F.array_join(F.slice(tokens, F.lit(1), F.aggregate(tokens, start, step)["n"]), " "))

    def split(body: Column) -> Column:
        return _once(F.when(F.startswith(body, F.lit("<<")), nested(body)).otherwise(F.substring_index(body, " ", 1)), lambda s: after(body, s))

    def after(body: Column, s: Column) -> Column:
        # The predicate holds no space, so it ends at the first one.
        rest = F.substring(body, F.length(s) + 2, F.length(body))
        return _once(rest, lambda r: _once(F.substring_index(r, " ", 1), lambda p: F.struct(
            s.alias("s"), p.alias("p"), F.substring(r, F.length(p) + 2, F.length(r)).alias("o")
        )))

    return F.when(is_triple(term), _once(F.substring(term, F.lit(4), F.length(term) - 6), split))


def _once(value: Column, use) -> Column:
    """Evaluate ``value`` once for all its uses, by way of a one-element array."""
    return F.transform(F.array(value), use)[0]
