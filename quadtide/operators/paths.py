"""Property paths as pair tables with columns ``x`` and ``y``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.session import shared_dir


# After this many rounds the tables of the single rounds are written into one.
COMPACT_ROUNDS = 16


def step(quads: DataFrame, predicate: str) -> DataFrame:
    """Pairs of one predicate."""
    return quads.where(F.col("p") == predicate).select(F.col("s").alias("x"), F.col("o").alias("y"))


def inverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))


def sequence(*parts: DataFrame) -> DataFrame:
    """p1/p2/...: bag of end points."""

    def chain(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumnRenamed("y", "__m").join(b.withColumnRenamed("x", "__m"), "__m").select("x", "y")

    return reduce(chain, parts)


def alternative(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def any_of(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """p1|p2|... over plain predicates: one scan."""
    return quads.where(F.col("p").isin(predicates)).select(F.col("s").alias("x"), F.col("o").alias("y"))


def none_of(quads: DataFrame, forward: list[str], backward: list[str] | None = None) -> DataFrame:
    """!(p|^q): any predicate but these, in either direction asked for."""
    parts = []
    if forward or not backward:
        kept = quads.where(~F.col("p").isin(forward)) if forward else quads
        parts.append(kept.select(F.col("s").alias("x"), F.col("o").alias("y")))
    if backward:
        kept = quads.where(~F.col("p").isin(backward))
        parts.append(kept.select(F.col("o").alias("x"), F.col("s").alias("y")))
    return alternative(*parts)


def nodes(quads: DataFrame) -> DataFrame:
    """Every subject and object: where a zero-length path may start."""
    return quads.select(F.explode(F.array("s", "o")).alias("x")).distinct()


def zero_or_one(pairs: DataFrame, domain: DataFrame) -> DataFrame:
    same = domain.select("x", F.col("x").alias("y"))
    return pairs.select("x", "y").unionByName(same).distinct()


def _closure(pairs: DataFrame) -> DataFrame:
    """Reachable pairs with the length of the shortest path, by doubling.

    A pair at a distance of m+1 to 2m has a node on its way that is m steps from its start, so with all
    pairs up to m one join gives those up to 2m: the rounds are the logarithm of the longest distance.
    Only pairs at exactly m are joined, and only new ones are written.
    """
    seen = pairs.select("x", "y", F.lit(1).alias("length")).distinct().checkpoint()
    last, m = seen, 1
    while not last.isEmpty():
        ahead = seen.select(F.col("x").alias("__m"), F.col("y").alias("__n"), F.col("length").alias("__l"))
        met = last.select("x", F.col("y").alias("__m")).join(ahead, "__m")
        met = met.groupBy("x", F.col("__n").alias("y")).agg((F.min("__l") + m).alias("length"))
        new = met.join(seen.select("x", "y"), ["x", "y"], "left_anti").checkpoint()
        seen, m = seen.unionByName(new), 2 * m
        last = new.where(F.col("length") == m)
    return seen


def one_or_more(pairs: DataFrame, starts: DataFrame | None = None, shortest: bool = False) -> DataFrame:
    """Reachable pairs, each once; with ``shortest`` also the length of the shortest path.

    Without ``starts`` by doubling. From given starts each round extends only the pairs found in the round
    before, as doubling would find the way from every node. Rounds are written to the checkpoint folder
    so that neither the plan nor the recomputation grows with the depth.
    """
    shared_dir(pairs.sparkSession)
    if starts is None:
        seen = _closure(pairs)
        return seen if shortest else seen.select("x", "y")
    edges = pairs.select("x", "y").distinct().checkpoint()
    first = edges.join(starts.select("x").distinct(), "x", "left_semi")
    seen = frontier = first.select("x", "y", F.lit(1).alias("length")).checkpoint()
    length = 1
    hop = edges.select(F.col("x").alias("__m"), F.col("y").alias("__n"))
    while not frontier.isEmpty():
        length += 1
        reached = frontier.join(hop, F.col("y") == F.col("__m")).select("x", F.col("__n").alias("y")).distinct()
        frontier = reached.join(seen.select("x", "y"), ["x", "y"], "left_anti")
        frontier = frontier.select("x", "y", F.lit(length).alias("length")).checkpoint()
        seen = seen.unionByName(frontier)
        if length % COMPACT_ROUNDS == 0:
            seen = seen.checkpoint()
    return seen if shortest else seen.select("x", "y")


def _ends(pairs: DataFrame) -> DataFrame:
    """(``x``, ``end``, ``steps``) of the nodes from which only one path leads on, and it ends: its last node
    and its length. Nodes that a fork or a cycle can be reached from are not among them.

    By doubling: each round a node takes the step of the node it stands at, so the rounds are the logarithm of
    the longest path, and a round holds one row a node.
    """
    out = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y"))
    forks = out.where("n > 1").select(F.col("x").alias("y"))
    last = pairs.select(F.col("y").alias("x")).distinct().join(out.select("x"), "x", "left_anti")
    at = out.where("n = 1").join(forks, "y", "left_anti").select("x", F.col("y").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done"))
    # Ends stand at themselves.
    at = at.unionByName(last.select("x", F.col("x").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done"))).checkpoint()
    nodes, reach = at.count(), 1
    while reach < nodes and not at.where(~F.col("done")).isEmpty():
        ahead = at.select(F.col("x").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("done").alias("__done"))
        # A node that stands where a fork follows leaves the table with it.
        met = at.drop("done").join(ahead, "at")
        at = met.select("x", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__done").alias("done")).checkpoint()
        reach *= 2
    # What still stands at no end after as many steps as there are nodes goes round a cycle.
    return at.where("done AND steps > 0").select("x", F.col("at").alias("end"), "steps")


def reach_counts(pairs: DataFrame) -> DataFrame:
    """(``x``, ``n``, ``longest``): how many nodes each one reaches by p+, and the distance of the farthest.

    The same as counting the pairs of :func:`shortest` by ``x``. Where one path leads on from a node and ends,
    both are its length, and no pairs are made; they are for nodes from which a fork or a cycle is reached.
    """
    shared_dir(pairs.sparkSession)
    edges = pairs.select("x", "y").distinct().checkpoint()
    plain = _ends(edges).select("x", F.col("steps").alias("n"), F.col("steps").cast("int").alias("longest")).checkpoint()
    rest = edges.select("x").distinct().join(plain, "x", "left_anti").checkpoint()
    if rest.isEmpty():
        return plain
    found = shortest(edges).join(rest, "x", "left_semi")
    return plain.unionByName(found.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")))


def at_least_counts(pairs: DataFrame, n: int) -> DataFrame:
    """(``x``, ``n``): how many paths of ``n`` steps or more, one at least, begin in each node that has one.

    The same as counting the rows of :func:`at_least` by ``x``, cycles being an error here too. Where one path
    leads on from a node and ends, it has one path of every length up to its own, and no paths are made.
    """
    if n < 1:
        raise ValueError("paths of length zero are not counted")
    shared_dir(pairs.sparkSession)
    edges = pairs.select("x", "y").checkpoint()
    plain = _ends(edges).checkpoint()
    count = plain.where(F.col("steps") >= n).select("x", (F.col("steps") - (n - 1)).alias("n"))
    rest = edges.select("x").distinct().join(plain.select("x"), "x", "left_anti").checkpoint()
    if rest.isEmpty():
        return count
    found = at_least(edges, n).join(rest, "x", "left_semi")
    return count.unionByName(found.groupBy("x").agg(F.count(F.lit(1)).alias("n")))


def zero_or_more(pairs: DataFrame, domain: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    same = domain.select("x", F.col("x").alias("y"))
    if starts is not None:
        same = same.join(starts.select("x").distinct(), "x", "left_semi")
    return one_or_more(pairs, starts).unionByName(same).distinct()


def times(pairs: DataFrame, n: int) -> DataFrame:
    """p{n}: bag of paths of exactly n steps, by repeated squaring."""
    if n < 1:
        raise ValueError("use zero_or_one for paths of length zero")
    power, out = pairs.select("x", "y"), None
    while n:
        if n & 1:
            out = power if out is None else sequence(out, power)
        n >>= 1
        if n:
            power = sequence(power, power)
    return out


def between_times(pairs: DataFrame, low: int, high: int, domain: DataFrame | None = None) -> DataFrame:
    """p{low,high}: bag over all lengths; ``domain`` is needed for length zero."""
    parts = []
    if low == 0:
        parts.append(domain.select("x", F.col("x").alias("y")))
    parts += [times(pairs, n) for n in range(max(low, 1), high + 1)]
    return alternative(*parts)


def at_least(pairs: DataFrame, n: int, domain: DataFrame | None = None) -> DataFrame:
    """p{n,}, p{+}, p{*}: every path as one row, of any length; data with a cycle have no end of paths and
    raise an error as soon as a path returns to its start.

    By doubling: all paths of 1 to m steps, and those of m steps followed by one of them, are all of 1 to
    2m steps, each once. No path of m steps is left once m exceeds the longest.
    """
    shared_dir(pairs.sparkSession)
    upto = exact = pairs.select("x", "y").checkpoint()
    new = upto
    while not exact.isEmpty():
        if not new.where("x = y").isEmpty():
            raise ValueError("the data have a cycle, so there is no end of paths")
        new = sequence(exact, upto).checkpoint()
        upto, exact = upto.unionByName(new), sequence(exact, exact).checkpoint()
    if n <= 1:
        return alternative(*([domain.select("x", F.col("x").alias("y"))] if n == 0 else []), upto)
    head = times(pairs, n).checkpoint()
    return head.unionByName(sequence(head, upto))


def distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select("x", "y").distinct()


def shortest(pairs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return one_or_more(pairs, starts, shortest=True)


def multi(pairs: DataFrame) -> DataFrame:
    """Every path counts: the bag as it is."""
    return pairs.select("x", "y")


def from_each(pairs: DataFrame, variables: tuple[str, str]) -> DataFrame:
    """Name the end points after two variables of the query."""
    return pairs.select(F.col("x").alias(variables[0]), F.col("y").alias(variables[1]))
