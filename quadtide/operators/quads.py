"""Statement tables: one row per (g, s, p, o), with typed views of the object next to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadtide.functions import terms
from quadtide.functions.binding import let
from quadtide.vocab import DEFAULT_GRAPH, GENERATED_AT, iri

KEY = ["g", "s", "p", "o"]
TYPED = ["o_num", "o_ts", "s_t", "o_t"]

_OBJECT_TYPE = "struct<o:string,o_num:double,o_ts:timestamp>"


def _object(o: Column, o_num: Column | None = None, o_ts: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        o.alias("o"),
        (none if o_num is None else o_num).cast("double").alias("o_num"),
        (none if o_ts is None else o_ts).cast("timestamp").alias("o_ts"),
    )


def resource(template: str, key: Column) -> Column:
    """Object that is an IRI built from a key, e.g. ``resource("http://x/nation/%s", col)``."""
    head, _, tail = template.partition("%s")
    return _object(F.concat(F.lit("<" + head), key.cast("string"), F.lit(tail + ">")))


def text_value(value: Column) -> Column:
    return _object(terms.string(value))


def double_value(value: Column) -> Column:
    return _object(terms.number(value), o_num=value)


def integer_value(value: Column) -> Column:
    from quadtide.vocab import XSD

    return _object(terms.number(value.cast("long"), XSD + "integer"), o_num=value)


def time_value(value: Column) -> Column:
    return _object(terms.date_time(value), o_ts=value)


def term_value(term: Column) -> Column:
    return _object(term)


def subject(template: str, key: Column) -> Column:
    return resource(template, key)["o"]


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))




def table_quads(
    df: DataFrame, s: Column, columns: dict[str, Column], g: Column | None = None,
    annotations: dict[str, dict[str, Column]] | None = None, keep: list[str] | None = None,
    also: list[tuple[Column, Column, str, Column]] | None = None,
) -> DataFrame:
    """Statement view of a table: one scan, one row per non-NULL cell.

    ``columns`` maps predicate terms to object columns. ``annotations`` maps a predicate to further
    statements *about* that statement. ``also`` lists statements with a graph and subject of their own.
    """
    keep = keep or []
    g = F.lit(DEFAULT_GRAPH) if g is None else g
    none = F.lit(None).cast(terms.TRIPLE_TYPE)

    def row(g: Column, s: Column, p: str, obj: Column, about: Column = none) -> Column:
        return F.struct(g.alias("g"), s.alias("s"), F.lit(p).alias("p"), obj.alias("v"), about.alias("s_t"))

    rows = []
    for p, obj in columns.items():
        rows.append(row(g, s, p, obj))
        for p2, obj2 in (annotations or {}).get(p, {}).items():
            about = F.when(obj["o"].isNotNull(), _triple(s, F.lit(p), obj["o"]))
            rows.append(row(g, terms.triple(s, F.lit(p), obj["o"]), p2, obj2, about))
    rows += [row(*extra) for extra in also or []]
    wide = df.select(*keep, F.explode(F.array(*rows)).alias("q"))
    out = wide.select(*keep, "q.g", "q.s", "q.p", "q.v.o", "q.v.o_num", "q.v.o_ts", "q.s_t")
    return out.withColumn("o_t", none).where(F.col("o").isNotNull() & F.col("s").isNotNull())


def constant_quads(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """A few statements given in the program text."""
    return with_typed(spark.createDataFrame(rows, "g string, s string, p string, o string"))


def with_typed(quads: DataFrame) -> DataFrame:
    """Add the typed views that are missing; unused ones are pruned away by the optimizer."""
    o, s = F.col("o"), F.col("s")
    views = {"o_num": terms.num(o), "o_ts": terms.moment(o), "s_t": terms.decode_triple(s), "o_t": terms.decode_triple(o)}
    return quads.withColumns({n: c for n, c in views.items() if n not in quads.columns})


def sorted_join(df: DataFrame) -> DataFrame:
    """A side of a join on terms that is never copied to every task.

    Terms are many times longer than the cells they are made of, but Spark's estimate, on which it decides to
    broadcast, starts from the size of the compressed files.
    """
    return df.hint("merge")


def distinct_quads(quads: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Set semantics: a dataset holds a statement once."""
    return quads.dropDuplicates([*(also or []), *KEY])


def assert_embedded(quads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Assert every embedded statement, at any depth, in the graph of the statement around it.

    One pass: a row is exchanged as one chain with all statements that its subject embeds in each other, and is
    unfolded behind that. Sorted chains have what they share next to each other, so each one yields the statements
    that the one before it has not. Chains about one innermost statement of a graph meet in one task, which sorts
    them on disk where its memory does not hold them.
    """
    keep = keep or []
    if "s_t" not in quads.columns:
        # Terms that are computed on the fly would otherwise be computed again for each of their parts.
        quads = let(quads, s=F.col("s"), o=F.col("o"))
    known = with_typed(quads).select(*keep, *KEY, *TYPED).withColumn("__in", terms.embedded_chains(F.col("s"), F.col("o")))
    inner = F.coalesce(F.col("__in.about.steps"), F.array().cast(terms.STEPS_TYPE))
    own = F.struct(F.coalesce("__in.about.root", "s").alias("root"), F.concat(inner, F.array(F.struct("p", "o"))).alias("steps"))
    every = F.posexplode(F.concat(F.array(own), F.col("__in.others"))).alias("__place", "__chain")
    chains = known.select(*keep, "g", *TYPED, every).select(
        *keep, "g", *TYPED, "__place", F.col("__chain.root").alias("__root"), F.col("__chain.steps").alias("__steps")
    )
    if quads.isStreaming:
        chains = chains.withColumn("__shared", F.lit(0))
    else:
        # Sorted by a number first: terms have their beginnings in common, which Spark compares before the rest.
        chains = chains.withColumn("__at", F.xxhash64(*keep, "g", "__root", F.col("__steps")[0]))
        order = Window.partitionBy("__at", *keep, "g", "__root").orderBy("__steps", "__place")
        same = F.zip_with("__steps", F.lag("__steps").over(order), lambda x, y: x.eqNullSafe(y))
        shared = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1
        chains = chains.withColumn("__shared", F.coalesce(shared, F.lit(0)))
    size = F.size("__steps")
    fresh = F.posexplode(F.slice("__steps", F.col("__shared") + 1, size - F.col("__shared"))).alias("__n", "__step")
    unfolded = chains.select("*", fresh).withColumn("__n", F.col("__shared") + F.col("__n"))
    # The row itself is the last statement of its chain.
    unfolded = unfolded.withColumn("__new", (F.col("__place") > 0) | (F.col("__n") < size - 1)).select(
        *keep, "g", terms.chain_term(F.col("__root"), F.col("__steps"), F.col("__n")).alias("s"), "__step.p", "__step.o",
        "__new", *[F.col(c).alias(f"__{c}") for c in TYPED],
    )
    s, o = F.col("s"), F.col("o")
    views = {"o_num": terms.num(o), "o_ts": terms.moment(o), "s_t": terms.decode_triple(s), "o_t": terms.decode_triple(o)}
    out = unfolded.select(
        *keep, *KEY, *[F.when(F.col("__new"), v).otherwise(F.col(f"__{c}")).alias(c) for c, v in views.items()]
    )
    return distinct_quads(out, keep) if quads.isStreaming else out


def element_times(quads: DataFrame, element: str = "elem_id") -> DataFrame:
    """Event time of each stream element: its generation time in the default graph, else the epoch."""
    time = F.max(F.when((F.col("g") == DEFAULT_GRAPH) & (F.col("p") == GENERATED_AT), F.col("o_ts")))
    return quads.groupBy(element).agg(F.coalesce(time, F.lit(0).cast("timestamp")).alias("elem_ts"))


def choose_graphs(quads: DataFrame, default: list[str] | None = None, named: list[str] | None = None) -> DataFrame:
    """FROM and FROM NAMED: the first become the default graph, the second stay named."""
    parts = []
    if default:
        merged = quads.where(F.col("g").isin(default)).withColumn("g", F.lit(DEFAULT_GRAPH))
        parts.append(distinct_quads(merged))
    if named:
        parts.append(quads.where(F.col("g").isin(named)))
    if not parts:
        return quads
    return reduce(DataFrame.unionByName, parts)


def wide_rows(quads: DataFrame, columns: dict[str, tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """One row per graph and subject from single-valued predicates.

    ``columns`` maps a column name to (predicate, value column). No predicate needs a join of its own. A maximum
    of texts is found by sorting, so rows are exchanged first: a task sorts its share of the subjects, which
    adaptive execution sizes, and not all that its part of a compressed table unfolds to.
    """
    keys = keys or ["g", "s"]
    wanted = sorted({p for p, _ in columns.values()})
    cells = [F.when(F.col("p") == p, F.col(v)).alias(n) for n, (p, v) in columns.items()]
    rows = quads.where(F.col("p").isin(wanted)).select(*keys, *cells).repartition(*keys)
    return rows.groupBy(*keys).agg(*[F.max(n).alias(n) for n in columns])


def write_quads(quads: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet clustered by predicate, subject, object: constant patterns skip row groups, hot ones spread."""
    cols = ["p", "s", "o"]
    laid = quads.repartitionByRange(files, *cols) if files else quads.repartitionByRange(*cols)
    laid.sortWithinPartitions(*cols).write.mode("errorifexists").parquet(path)


def named(graph: str) -> str:
    return graph if graph == DEFAULT_GRAPH or graph.startswith("<") else iri(graph)
