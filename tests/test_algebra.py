import random

import pytest

from pyspark.sql import functions as F

from quadtide.operators import algebra as a
from quadtide.operators import forms as f
from quadtide.operators import grouping as g
from quadtide.operators import paths as h
from quadtide.operators import skew
from quadtide.plans.catalog import paths as catalog_paths
from quadtide.sources.tables import Tables
from tests.conftest import rows


def compatible(l, r, shared):
    return all(l[c] is None or r[c] is None or l[c] == r[c] for c in shared)


def _tables(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 1, 2, 3])
    left = [{"k": rng.randint(0, 1), "x": pick(), "y": pick(), "l": i} for i in range(12)]
    right = [{"k": rng.randint(0, 1), "x": pick(), "y": pick(), "r": i} for i in range(9)]
    ls, rs = "k int, x int, y int, l int", "k int, x int, y int, r int"
    make = lambda data, schema: spark.createDataFrame([tuple(d.values()) for d in data], schema)
    return left, right, make(left, ls), make(right, rs)


def test_unbound_shared_variables(spark):
    shared, maybe = ["k", "x", "y"], ["x", "y"]
    for seed in range(1):
        left, right, L, R = _tables(spark, seed)
        merged = [
            (l["k"], l["x"] if l["x"] is not None else r["x"], l["y"] if l["y"] is not None else r["y"], l["l"], r["r"])
            for l in left for r in right if compatible(l, r, shared)
        ]
        key = lambda t: tuple((v is None, str(v)) for v in t)
        assert rows(a.join(L, R, maybe), "k", "x", "y", "l", "r") == sorted(merged, key=key)
        matched = {l["l"] for l in left if any(compatible(l, r, shared) for r in right)}
        everyone = {l["l"] for l in left}
        assert {r.l for r in a.exists(L, R, maybe).collect()} == matched and a.exists(L, R, maybe).count() == len(matched)
        assert {r.l for r in a.not_exists(L, R, maybe).collect()} == everyone - matched
        assert a.optional(L, R, maybe=maybe).count() == len(merged) + len(everyone - matched)


def test_optional_with_inner_filter_and_unbound_variables(spark):
    value = lambda l, r, c: l[c] if l[c] is not None else r[c]
    for shared, maybe, right_maybe in ((["k", "x", "y"], ["x", "y"], ["x", "y"]), (["x", "y"], ["x", "y"], ["y"]), (["x"], ["x"], [])):
        left, right, L, R = _tables(spark, 5)
        bound = [c for c in shared if c not in right_maybe]
        right = [r for r in right if all(r[c] is not None for c in bound)]
        R = R.where(" AND ".join(f"{c} IS NOT NULL" for c in bound) or "true")
        expected = []
        for l in left:
            found = [
                (*(value(l, r, c) for c in shared), l["l"], r["r"]) for r in right
                if compatible(l, r, shared) and r["r"] > l["l"] - 4 and value(l, r, "x") is not None and value(l, r, "x") > 1
            ]
            expected += found or [(*(l[c] for c in shared), l["l"], None)]
        got = a.optional(L.select(*shared, "l"), R.select(*shared, "r"), (F.col("r") > F.col("l") - 4) & (F.col("x") > 1), maybe, right_maybe)
        key = lambda t: tuple((v is None, str(v)) for v in t)
        assert sorted((tuple(r) for r in got.select(*shared, "l", "r").collect()), key=key) == sorted(expected, key=key)


def test_optional_without_shared_variables_broadcasts_nothing_unchecked(spark):
    left, right = spark.range(6).withColumnRenamed("id", "l"), spark.range(4).withColumnRenamed("id", "r")
    got = a.optional(left, right, F.col("r") > F.col("l"))
    assert rows(got, "l", "r") == sorted(
        [(l, r) for l in range(6) for r in range(4) if r > l] + [(l, None) for l in range(3, 6)], key=lambda t: tuple((v is None, str(v)) for v in t)
    )
    assert a.optional(left, right.where("false")).count() == 6
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_minus_needs_a_shared_bound_variable(spark):
    for seed in range(3):
        left, right, _, _ = _tables(spark, seed)
        cut = lambda d: {k: v for k, v in d.items() if k != "k"}
        left, right = [cut(x) for x in left], [cut(x) for x in right]
        L = spark.createDataFrame([tuple(d.values()) for d in left], "x int, y int, l int")
        R = spark.createDataFrame([tuple(d.values()) for d in right], "x int, y int, r int")

        def removed(l):
            return any(compatible(l, r, "xy") and any(l[c] is not None and r[c] is not None for c in "xy") for r in right)

        assert {r.l for r in a.minus(L, R, ["x", "y"]).collect()} == {l["l"] for l in left if not removed(l)}


def test_empty_group_is_the_join_identity(spark):
    one = a.group(spark)
    assert one.count() == 1 and one.columns == []
    assert a.join(spark.range(3), one).count() == 3


def test_let_and_bind(spark):
    df = spark.createDataFrame([(1, 2), (2, 2)], "a int, b int")
    assert a.let_(df, "a", F.col("b")).count() == 1
    assert a.let_(df, "c", F.col("b") * 2).columns == ["a", "b", "c"]


def test_skew_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("l"))
    right = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("r"))
    want = rows(left.join(right, "k"), "k", "l", "r")
    assert rows(skew.skew_join(left, right, ["k"], salts=5), "k", "l", "r") == want
    assert skew.hot_keys(left, ["k"], 0.1).count() == 1


def test_count_distinct_in_two_steps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2), ("c", None)], "k string, v int")
    assert rows(skew.count_distinct_by(df, ["k"], ["v"], "n")) == [("a", 1), ("b", 1), ("c", 0)]


def test_empty_aggregates(spark):
    df = spark.createDataFrame([], "x double")
    got = df.agg(g.sum_(F.col("x")).alias("s"), g.avg(F.col("x")).alias("a"), g.count_all().alias("n"), g.sample(F.col("x")).alias("any")).first()
    assert tuple(got) == (0.0, 0.0, 0, None)


def test_order_of_terms(spark):
    data = ['"b"', None, "<http://a>", '"10"^^<http://www.w3.org/2001/XMLSchema#integer>', "_:x", '"9"^^<http://www.w3.org/2001/XMLSchema#integer>']
    df = spark.createDataFrame([(d,) for d in data], "o string")
    got = [r.o for r in g.order_terms(df, ("o", True)).collect()]
    assert got[:3] == [None, "_:x", "<http://a>"] and got.index(data[5]) < got.index(data[3])


def test_paths_over_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    pairs = spark.createDataFrame(edges, "x string, y string")
    nodes = set("abcd")
    reach = {(x, y) for x in "abc" for y in "abcd"}
    assert set(rows(h.one_or_more(pairs))) == reach
    domain = spark.createDataFrame([(n,) for n in nodes], "x string")
    assert set(rows(h.zero_or_more(pairs, domain))) == reach | {("d", "d")}
    starts = spark.createDataFrame([("c",)], "x string")
    assert set(rows(h.one_or_more(pairs, starts))) == {("c", y) for y in "abcd"}
    short = {(r.x, r.y): r.length for r in h.shortest(pairs).collect()}
    assert short[("a", "d")] == 3 and short[("a", "a")] == 3
    assert rows(h.times(pairs, 5), "x", "y") == rows(h.sequence(pairs, pairs, pairs, pairs, pairs))
    assert h.between_times(pairs, 0, 2, domain).count() == 4 + 4 + h.times(pairs, 2).count()


def test_paths_count_every_way(spark):
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "x string, y string")
    assert rows(h.at_least(diamond, 2)) == [("a", "d"), ("a", "d")]
    assert set(rows(h.one_or_more(diamond))) == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distances_by_doubling(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(18), rng.randrange(18)) for _ in range(24)} | {(n, n + 1) for n in range(20, 33)}
    want = {}
    for x in {a for a, _ in edges}:
        level, length = {x}, 0
        while level := {b for a, b in edges if a in level} - {y for (s, y) in want if s == x}:
            length += 1
            want.update({(x, y): length for y in level})
    got = h.shortest(spark.createDataFrame(sorted(edges), "x long, y long")).collect()
    assert {(r.x, r.y): r.length for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("least", [0, 1, 2, 5])
def test_bags_of_paths_by_doubling(spark, least):
    rng = random.Random(9)
    edges = [(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3] + [(0, 1), (3, 5)]
    level = want = [(x, x) for x in range(12)]
    want = list(want) if least == 0 else []
    for length in range(1, 13):
        level = [(x, b) for x, y in level for a, b in edges if a == y]
        want += level if length >= least else []
    pairs, domain = spark.createDataFrame(edges, "x long, y long"), spark.createDataFrame([(n,) for n in range(12)], "x long")
    assert sorted(map(tuple, h.at_least(pairs, least, domain).collect())) == sorted(want)


def test_long_chains_and_cycles(spark):
    chain = spark.range(2500).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert h.shortest(chain, spark.createDataFrame([(2400,)], "x long")).count() == 100
    far = h.shortest(chain)
    assert far.count() == 2500 * 2501 // 2 and far.agg(F.max("length")).first()[0] == 2500
    assert h.at_least(chain, 1500).count() == 1001 * 1002 // 2
    for ring in (1, 2, 7):
        cycle = spark.range(ring).select(F.col("id").alias("x"), ((F.col("id") + 1) % ring).alias("y"))
        with pytest.raises(ValueError, match="cycle"):
            h.at_least(chain.where("x < 20").union(cycle), 1)


def test_construct_blank_nodes_per_solution(spark):
    sol = spark.createDataFrame([("<http://a>", '"1"'), ("<http://b>", None)], "s string, o string")
    got = f.construct(sol, [("_:n", "<http://p>", "?s"), ("_:n", "<http://q>", "?o")])
    by_node = {}
    for r in got.collect():
        by_node.setdefault(r.s, []).append(r.p)
    assert sorted(len(v) for v in by_node.values()) == [1, 2]


def test_construct_from_equal_solutions(spark):
    sol = spark.createDataFrame([("<http://a>",)] * 3, "s string")
    assert f.construct(sol, [("_:n", "<http://p>", "?s")]).count() == 3


def test_inserted_statements_bring_what_they_embed(spark):
    quads = spark.createDataFrame([("g", "<s>", "<p>", "<o>")], "g string, s string, p string, o string")
    more = spark.createDataFrame([("g", "<< <http://a> <http://b> <http://c> >>", "<http://d>", "<http://e>")], quads.schema)
    assert ("g", "<http://a>", "<http://b>", "<http://c>") in rows(f.insert_data(quads, more))
    both = f.modify(quads, more.select("s"), insert=[("<http://x>", "<http://y>", "?s")], with_graph="g")
    assert ("g", "<http://a>", "<http://b>", "<http://c>") in rows(both) and both.count() == 3


def test_places_in_an_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = g.numbered(df.repartition(5), F.col("x").desc())
    assert got.count() == 1000 and got.where("x + position != 1000").count() == 0
    assert g.numbered(df.limit(0), F.col("x")).count() == 0


def test_updates(spark):
    quads = spark.createDataFrame([("g", "<s>", "<p>", "<o>"), ("h", "<s>", "<p>", "<x>")], "g string, s string, p string, o string")
    swap = f.modify(quads, quads.where("g = 'g'").select("s", "o"), [("?s", "<p>", "?o")], [("?o", "<p>", "?s")], with_graph="g")
    assert rows(swap) == [("g", "<o>", "<p>", "<s>"), ("h", "<s>", "<p>", "<x>")]
    assert rows(f.copy_graph(quads, "g", "h"), "g", "o") == [("g", "<o>"), ("h", "<o>")]
    assert rows(f.move_graph(quads, "g", "h"), "g", "o") == [("h", "<o>")]
    assert f.add_graph(quads, "g", "h").count() == 3
    assert f.clear(quads, "g").count() == 1 and f.clear(quads, "ALL").count() == 0


def test_describe_follows_blank_nodes(spark):
    data = [("g", "<a>", "p", "_:1"), ("g", "_:1", "p", "_:2"), ("g", "_:2", "p", "_:1"), ("g", "_:2", "q", "<b>"), ("g", "<b>", "q", "<a>")]
    quads = spark.createDataFrame(data, "g string, s string, p string, o string")
    got = f.describe(quads, spark.createDataFrame([("<a>",)], "s string"))
    assert got.count() == 4


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_paths_equal_counted_paths(spark, seed):
    r = random.Random(seed)
    # Trees towards an end, some with forks, and for reached nodes cycles and equal rows too.
    edges = [(n, r.randrange(max(0, n - 4), n)) for n in range(1, 40) if n % 11]
    edges += [(n, r.randrange(0, n)) for n in range(20, 40, 9)] if seed % 2 else []
    pairs = spark.createDataFrame(edges + edges[:1], "x long, y long")
    want = h.at_least(pairs, 2).groupBy("x").count()
    assert rows(h.at_least_counts(pairs, 2), "x", "n") == rows(want)
    if seed > 1:
        pairs = pairs.union(spark.createDataFrame([(50, 51), (51, 52), (52, 51), (53, 50), (60, 60)], "x long, y long"))
    want = h.shortest(pairs).groupBy("x").agg(F.count("y"), F.max("length"))
    assert rows(h.reach_counts(pairs), "x", "n", "longest") == rows(want)
    if seed > 1:
        with pytest.raises(ValueError):
            h.at_least_counts(pairs, 2)


def test_counts_along_a_long_chain(spark):
    # Pairs of this chain would be 1.8 billion.
    chain = spark.range(60_000).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    got = h.reach_counts(chain)
    assert got.count() == 60_000 and got.where("x = 0 AND n = 60000 AND longest = 60000").count() == 1
    assert h.at_least_counts(chain, 3).where("n = 60000 - x - 2").count() == 59_998


def test_equal_supply_lines_are_found_by_their_keys(spark):
    # The statements' text is much longer than the two numbers it is made of.
    plan = catalog_paths._supply(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan
