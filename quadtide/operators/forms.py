"""CONSTRUCT, ASK, DESCRIBE, and updates as table-to-table transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.operators.patterns import Quoted, is_var
from quadtide.operators.quads import KEY, TYPED, assert_embedded, distinct_quads, sorted_join, with_typed
from quadtide.session import shared_dir
from quadtide.vocab import DEFAULT_GRAPH

Template = list[tuple]  # (s, p, o) or (s, p, o, g)


def _term(position, columns: list[str]) -> Column:
    if isinstance(position, Quoted):
        return terms.triple(*[_term(x, columns) for x in (position.s, position.p, position.o)])
    if is_var(position):
        return F.col(position[1:])
    if position.startswith("_:"):
        # A blank node of the template is new in every solution, equal ones too, and the same within one.
        return F.concat(F.lit(position + "_"), F.col("__solution").cast("string"))
    return F.lit(position)


def _positions(parts) -> list:
    """Terms of a template, those of embedded statements too."""
    return [y for x in parts for y in (_positions((x.s, x.p, x.o)) if isinstance(x, Quoted) else [x])]


def construct(solutions: DataFrame, template: Template) -> DataFrame:
    """Statements of a template filled with every solution; incomplete or ill-formed ones are left out."""
    rows = []
    if any(isinstance(x, str) and x.startswith("_:") for t in template for x in _positions(t)):
        solutions = solutions.withColumn("__solution", F.monotonically_increasing_id())
    for t in template:
        s, p, o = (_term(x, solutions.columns) for x in t[:3])
        g = _term(t[3], solutions.columns) if len(t) > 3 else F.lit(DEFAULT_GRAPH)
        rows.append(F.struct(g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o")))
    filled = solutions.select(F.explode(F.array(*rows)).alias("q")).select("q.*")
    whole = filled.where(
        F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
        & ~terms.is_literal(F.col("s")) & terms.is_iri(F.col("p"))
    )
    return distinct_quads(whole)


def ask(solutions: DataFrame) -> DataFrame:
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def describe(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Statements about the resources (column ``s``) and about the blank nodes they lead to."""
    shared_dir(quads.sparkSession)
    links = quads.where(terms.is_blank(F.col("o"))).select(F.col("s").alias("__from"), F.col("o").alias("__to")).checkpoint()
    seen = frontier = resources.select("s").distinct().withColumn("__round", F.lit(0)).checkpoint()
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        reached = links.join(frontier, F.col("__from") == F.col("s"), "left_semi").select("__to").distinct()
        fresh = reached.join(seen, F.col("__to") == F.col("s"), "left_anti")
        frontier = fresh.select(F.col("__to").alias("s"), F.lit(rounds).alias("__round")).checkpoint()
        seen = seen.unionByName(frontier)
    return quads.join(seen.select("s"), "s", "left_semi")


def _same_columns(quads: DataFrame, other: DataFrame) -> DataFrame:
    missing = [c for c in quads.columns if c not in other.columns]
    return (with_typed(other) if set(missing) & set(TYPED) else other).select(*quads.columns)


def insert_data(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows come in with the statements they embed."""
    more = [c for c in quads.columns if c not in (*KEY, *TYPED)]
    return distinct_quads(quads.unionByName(_same_columns(quads, assert_embedded(rows, keep=more))))


def delete_data(quads: DataFrame, rows: DataFrame) -> DataFrame:
    return quads.join(sorted_join(rows.select(*KEY).distinct()), KEY, "left_anti").select(*quads.columns)


def delete_where(quads: DataFrame, solutions: DataFrame, template: Template) -> DataFrame:
    return delete_data(quads, construct(solutions, template))


def modify(quads: DataFrame, solutions: DataFrame, delete: Template | None = None, insert: Template | None = None,
           with_graph: str | None = None) -> DataFrame:
    """DELETE / INSERT / WHERE: both templates see the solutions of the state before."""

    def placed(template: Template) -> Template:
        return [t if len(t) > 3 or with_graph is None else (*t, with_graph) for t in template]

    out = quads
    if delete:
        out = delete_data(out, construct(solutions, placed(delete)))
    if insert:
        out = insert_data(out, construct(solutions, placed(insert)))
    return out


def clear(quads: DataFrame, target: str) -> DataFrame:
    """CLEAR or DROP a graph, or DEFAULT, NAMED, ALL."""
    g = F.col("g")
    if target == "ALL":
        return quads.where(F.lit(False))
    if target == "DEFAULT":
        return quads.where(g != DEFAULT_GRAPH)
    if target == "NAMED":
        return quads.where(g == DEFAULT_GRAPH)
    return quads.where(g != target)


def _in_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads.where(F.col("g") == source).withColumn("g", F.lit(target))


def add_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    return quads if source == target else distinct_quads(quads.unionByName(_in_graph(quads, source, target)))


def copy_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    """The target holds exactly the source's statements afterwards."""
    if source == target:
        return quads
    return quads.where(F.col("g") != target).unionByName(_in_graph(quads, source, target))


def move_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    if source == target:
        return quads
    kept = quads.where(F.col("g") != target)
    return kept.withColumn("g", F.when(F.col("g") == source, target).otherwise(F.col("g")))
