"""Pattern matching over statement tables.

A position of a pattern is a variable (``"?x"``), a constant term, ``None`` (anything), or, for
subject and object, a :class:`Quoted` statement. A match is a DataFrame with one column per variable.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.operators.quads import KEY, TYPED, sorted_join, with_typed
from quadtide.vocab import (
    DEFAULT_GRAPH, RDF_OBJECT, RDF_PREDICATE, RDF_STATEMENT, RDF_SUBJECT, RDF_TYPE,
)


@dataclass(frozen=True)
class Quoted:
    """An embedded statement; ``ref`` binds the statement itself."""

    s: str | Quoted | None
    p: str | None
    o: str | Quoted | None
    ref: str | None = None


@dataclass(frozen=True)
class Pattern:
    s: str | Quoted | None
    p: str | None
    o: str | Quoted | None
    g: str | None = None
    carry: dict[str, str] = field(default_factory=dict)  # output column -> typed quad column


def is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def match(quads: DataFrame, pattern: Pattern, keep: list[str] | None = None, asserted: bool = True) -> DataFrame:
    """Solutions of one pattern.

    An embedded pattern is found where its inner statement is in the same graph too. ``asserted=False``
    is the caller's word that no inner statement is missing, as in what the readers give; the outer row
    alone answers it then.
    """
    keep = keep or []
    quads = with_typed(quads) if any(isinstance(x, Quoted) for x in (pattern.s, pattern.o)) else quads
    bound: dict[str, object] = {}
    conditions = []

    def bind(position, column):
        if position is None:
            return
        if isinstance(position, Quoted):
            raise AssertionError("handled by open_quoted")
        if is_var(position):
            name = position[1:]
            if name in bound:
                conditions.append(bound[name] == column)
            else:
                bound[name] = column
        else:
            conditions.append(column == position)

    checks = []

    def open_quoted(position, term, parts):
        if not isinstance(position, Quoted):
            bind(position, term)
            return
        conditions.append(parts.isNotNull())
        checks.append((position, parts))
        if position.ref:
            bind(position.ref, term)
        bind(position.p, parts["p"])
        for inner, name in ((position.s, "s"), (position.o, "o")):
            open_quoted(inner, parts[name], terms.decode_triple(parts[name]) if isinstance(inner, Quoted) else None)

    open_quoted(pattern.s, F.col("s"), F.col("s_t") if "s_t" in quads.columns else None)
    bind(pattern.p, F.col("p"))
    bind(pattern.g, F.col("g"))
    open_quoted(pattern.o, F.col("o"), F.col("o_t") if "o_t" in quads.columns else None)

    out = quads
    for c in conditions:
        out = out.where(c)
    if asserted:
        for position, parts in checks:
            # Only what the constants of the embedded pattern allow can be its inner statement.
            wanted = {c: x for c, x in zip("spo", (position.s, position.p, position.o)) if isinstance(x, str) and not is_var(x)}
            if isinstance(pattern.g, str) and not is_var(pattern.g):
                wanted["g"] = pattern.g
            inner = reduce(lambda df, c: df.where(F.col(c) == wanted[c]), wanted, quads)
            inner = sorted_join(inner.select(*[F.col(c).alias(f"__i_{c}") for c in KEY]))
            cond = (F.col("g") == F.col("__i_g"))
            for c in "spo":
                cond = cond & (parts[c] == F.col(f"__i_{c}"))
            out = out.join(inner, cond, "left_semi")
    cols = [c.alias(n) for n, c in bound.items()]
    extra = [F.col(src).alias(n) for n, src in pattern.carry.items()]
    return out.select(*keep, *cols, *extra)


def contains(quads: DataFrame, s: str, p: str, o: str, g: str) -> DataFrame:
    """One row: is this statement there?"""
    found = quads.where((F.col("g") == g) & (F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("found"))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs. Spark copies a side whose size in bytes is below its threshold, else pairs partitions."""
    return left.crossJoin(right)


def join_solutions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the shared variables, by term identity."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(sorted_join(right), shared, "inner") if shared else cross(left, right)


def conjunction(parts: list[DataFrame]) -> DataFrame:
    """Join of several solution tables, each time with one that shares a variable where there is one."""
    out, rest = parts[0], list(parts[1:])
    while rest:
        i = next((i for i, r in enumerate(rest) if set(r.columns) & set(out.columns)), 0)
        out = join_solutions(out, rest.pop(i))
    return out


def basic_pattern(quads: DataFrame, patterns: list[Pattern], keep: list[str] | None = None, asserted: bool = True) -> DataFrame:
    """Conjunction of patterns over one table (``keep``: tick or element columns to agree on)."""
    out = conjunction([match(quads, p, keep, asserted) for p in patterns])
    hidden = [c for c in out.columns if c.startswith("__anon")]
    return out.drop(*hidden)


_anonymous = count()


def blank() -> str:
    """A variable for a blank node in a pattern; it is not part of the result."""
    return f"?__anon{next(_anonymous)}"


def about(s: str | Quoted, properties: dict[str, str | list], g: str | None = None) -> list[Pattern]:
    """``s p1 o1 , o2 ; p2 o3``. A dict as an object is a blank node with its own properties."""
    out = []
    for p, objects in properties.items():
        for o in objects if isinstance(objects, list) else [objects]:
            if isinstance(o, dict):
                node = blank()
                out.append(Pattern(s, p, node, g))
                out += about(node, o, g)
            else:
                out.append(Pattern(s, p, o, g))
    return out


def collection(head: str, items: list[str], g: str | None = None) -> list[Pattern]:
    """Patterns of an rdf list with exactly these members, hanging at variable ``head``."""
    from quadtide.vocab import RDF_FIRST, RDF_NIL, RDF_REST

    out, node = [], head
    for i, item in enumerate(items):
        nxt = RDF_NIL if i == len(items) - 1 else blank()
        out += [Pattern(node, RDF_FIRST, item, g), Pattern(node, RDF_REST, nxt, g)]
        node = nxt
    return out


def in_graph(quads: DataFrame, graph: str) -> DataFrame:
    """GRAPH <g>: restrict; GRAPH ?g: every named graph, never the default one."""
    if is_var(graph):
        return quads.where(F.col("g") != DEFAULT_GRAPH)
    return quads.where(F.col("g") == graph)


def reify(quads: DataFrame) -> DataFrame:
    """Replace embedded statements, as subject and as object, by rdf:Statement nodes.

    One level: what is embedded in an embedded statement stays inside the node's description.
    """
    known = with_typed(quads)
    none = F.lit(None).cast(terms.TRIPLE_TYPE)
    # A digest is never NULL. Told so, Spark adds no check to some readings of a node only, and shares the exchange of all.
    digest = lambda term: F.coalesce(F.sha2(F.concat_ws(" ", F.col("g"), term), 256), F.lit(""))
    node = lambda term: terms.bnode(digest(term))
    place = lambda c: F.when(F.col(f"{c}_t").isNotNull(), node(F.col(c))).otherwise(F.col(c)).alias(c)
    outer = known.select("g", place("s"), "p", place("o"), "o_num", "o_ts", none.alias("s_t"), none.alias("o_t"))
    ends = F.array(*[F.struct(F.col(c).alias("term"), F.col(f"{c}_t").alias("t")) for c in "so"])
    parts = known.where("s_t IS NOT NULL OR o_t IS NOT NULL").select("g", F.explode(ends).alias("x")).where("x.t IS NOT NULL")
    parts = parts.select("g", node(F.col("x.term")).alias("s"), "x.t").distinct()
    pairs = F.array(*[
        F.struct(F.lit(p).alias("p"), o.alias("o"))
        for p, o in (
            (RDF_TYPE, F.lit(RDF_STATEMENT)), (RDF_SUBJECT, F.col("t.s")), (RDF_PREDICATE, F.col("t.p")), (RDF_OBJECT, F.col("t.o")),
        )
    ])
    described = with_typed(parts.select("g", "s", F.explode(pairs).alias("x")).select("g", "s", "x.p", "x.o"))
    return outer.unionByName(described.select(*KEY, *TYPED))


def unreify(quads: DataFrame) -> DataFrame:
    """Every statement, with embedded statements in place of the rdf:Statement nodes that describe them.

    The descriptions go; a node without subject, predicate and object stays as it is.
    """
    known = with_typed(quads)
    props = {"t_s": RDF_SUBJECT, "t_p": RDF_PREDICATE, "t_o": RDF_OBJECT}
    aggs = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in props.items()]
    nodes = known.where(F.col("p").isin(*props.values())).groupBy("g", F.col("s").alias("node")).agg(*aggs)
    nodes = nodes.where(F.col("t_s").isNotNull() & F.col("t_p").isNotNull() & F.col("t_o").isNotNull())
    parts = F.struct(F.col("t_s").alias("s"), F.col("t_p").alias("p"), F.col("t_o").alias("o"))
    nodes = sorted_join(nodes.select("g", "node", parts.alias("t")))
    at = lambda c: nodes.select(F.col("g"), F.col("node").alias(c), F.col("t").alias(f"__{c}"))
    rows = known.join(at("s"), ["g", "s"], "left").join(at("o"), ["g", "o"], "left")
    own = F.col("p").isin(*props.values()) | ((F.col("p") == RDF_TYPE) & (F.col("o") == RDF_STATEMENT))
    rows = rows.where(F.col("__s").isNull() | ~own)

    def term(c: str):
        t = F.col(f"__{c}")
        return F.when(t.isNotNull(), terms.triple(t["s"], t["p"], t["o"])).otherwise(F.col(c)).alias(c)

    back = [F.coalesce(f"__{c}", f"{c}_t").alias(f"{c}_t") for c in "so"]
    return rows.select("g", term("s"), "p", term("o"), "o_num", "o_ts", *back)
