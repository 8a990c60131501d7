import math

import pytest
from pyspark.sql import functions as F

from quadtide.functions import uncertainty as u
from quadtide.functions.binding import let

N, U = u.normal, u.uniform


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "expr, want",
    [
        (lambda: u.less_than(N(0, 1), 0), 0.5), (lambda: u.less_than(N(0.2, 0.005), 0.18), 0.388648),
        (lambda: u.less_or_equal(u.add(U(-0.01, 0.01), 0.185), 0.18), 0.25), (lambda: u.greater_than(N(29.5, 0.5), 30), 0.239750),
        (lambda: u.between(N(0, 1), -1, 1), 0.682689), (lambda: u.less_than(N(0, 1), N(1, 3)), 0.691462),
        (lambda: u.less_than(U(0, 2), U(1, 4)), 0.916667), (lambda: u.less_than(U(0, 1), U(0, 1)), 0.5),
        (lambda: u.less_than(N(0, 1), U(-1, 2)), 0.641725), (lambda: u.less_than(U(-1, 2), N(0, 1)), 0.358275),
        (lambda: u.less_than(U(0, 1), U(2, 3)), 1.0), (lambda: u.greater_than(U(0, 1), U(2, 3)), 0.0),
        (lambda: u.greater_or_equal(U(0, 1), 0.25), 0.75),
    ],
)
def test_closed_forms(spark, expr, want):
    assert value(spark, expr()) == pytest.approx(want, abs=1e-6)


def test_normal_distribution_function(spark):
    df = spark.range(-1200, 1201).select((F.col("id") / 100).alias("z"))
    for r in df.select("z", u.phi(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=5e-16)
    assert value(spark, u.phi(F.lit(1e200))) == 1.0


def test_sums(spark):
    def text(x):
        return value(spark, x.text())

    assert text(u.add(N(0, 1), N(2, 3))) == "N(2.0, 4.0)"
    assert text(u.subtract(N(0, 1), N(2, 3))) == "N(-2.0, 4.0)"
    assert text(u.add(U(-1, 1), 5)) == "U(4.0, 6.0)"
    assert value(spark, u.add(2, 3).a) == 5.0


@pytest.mark.parametrize("expr", [
    lambda: u.add(5, U(-1, 1)).struct(), lambda: u.add(U(0, 1), U(0, 1)).struct(), lambda: u.less_than(5, N(0, 1)),
    lambda: u.less_than(5, 3), lambda: u.between(N(0, 1), 1, -1), lambda: N(0, 0).struct(), lambda: N(0, -1).struct(),
])
def test_errors_are_null(spark, expr):
    assert value(spark, expr()) is None


def test_parse(spark):
    texts = ["N(0,1)", "N( 1.5 , 2e-1 )", "U(-1, 1)", "X(1,2)", "N(0,0)", "U(3,1)", "", "N(1)", "N(1,2", None, "N(a,b)"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.d for r in df.select("i", u.parse(F.col("x")).alias("d")).collect()}
    assert [tuple(got[i]) for i in range(3)] == [("N", 0.0, 1.0), ("N", 1.5, 0.2), ("U", -1.0, 1.0)]
    assert all(got[i] is None for i in range(3, len(texts)))


def test_mixed_kinds_in_one_column(spark):
    df = spark.createDataFrame([("N", 0.0, 1.0), ("U", 0.0, 2.0), ("K", 1.0, 1.0)], "kind string, a double, b double")
    x = u.from_columns(F.col("kind"), F.col("a"), F.col("b"))
    got = {r.kind: r for r in df.select(
        "kind", u.less_or_equal(x, 1).alias("p"), u.less_than(N(0, 1), x).alias("q"), u.add(N(0, 1), x).a.alias("m"), u.between(x, 0, 1).alias("b"),
    ).collect()}
    assert got["U"].p == 0.5 and got["K"].p is None and got["N"].p == pytest.approx(0.841345, abs=1e-6)
    assert got["N"].q == 0.5 and got["K"].q == pytest.approx(0.841345, abs=1e-6)
    assert (got["N"].m, got["U"].m, got["K"].m) == (0.0, None, 1.0)
    assert got["K"].b == 1.0


def test_closed_forms_agree_with_sampling(spark):
    pairs = [("N", 0.0, 1.0, "U", -1.0, 2.0), ("U", 0.0, 3.0, "N", 1.0, 4.0), ("U", 0.0, 2.0, "U", 1.0, 4.0), ("N", 1.0, 2.0, "N", 2.0, 1.0)]
    df = spark.createDataFrame(pairs, "xk string, xa double, xb double, yk string, ya double, yb double")
    x = F.struct(F.col("xk").alias("kind"), F.col("xa").alias("a"), F.col("xb").alias("b"))
    y = F.struct(F.col("yk").alias("kind"), F.col("ya").alias("a"), F.col("yb").alias("b"))
    cx, cy = u.from_columns(F.col("xk"), F.col("xa"), F.col("xb")), u.from_columns(F.col("yk"), F.col("ya"), F.col("yb"))
    sampled = u.sampled_less_than(20_000)(x, y)
    for r in df.select(u.less_than(cx, cy).alias("p"), u.greater_than(cx, cy).alias("q"), sampled.alias("s"), sampled.alias("again")).collect():
        assert r.p + r.q == pytest.approx(1.0)
        assert abs(r.p - r.s) < 0.012
        assert r.s == r.again


def test_registered_family_is_sampled(spark):
    u.register_kind("T", u.Kind(
        valid=lambda a, b: a < b, cdf=lambda a, b, k: F.lit(None).cast("double"), shift=lambda a, b, k: (a + k, b + k),
        draw=lambda rng, a, b, n: rng.triangular(a, (a + b) / 2, b, n),
    ))
    try:
        sampled = u.sampled_less_than(20_000)
    finally:
        u.KINDS.pop("T")
    df = spark.createDataFrame([("T", 0.0, 2.0, "K", 1.0), ("T", 0.0, 2.0, "K", 0.5), ("?", 0.0, 2.0, "K", 0.5)], "xk string, xa double, xb double, yk string, ya double")
    x = F.struct(F.col("xk").alias("kind"), F.col("xa").alias("a"), F.col("xb").alias("b"))
    y = F.struct(F.col("yk").alias("kind"), F.col("ya").alias("a"), F.lit(None).cast("double").alias("b"))
    half, eighth, none = [r.p for r in df.select(sampled(x, y).alias("p")).collect()]
    assert abs(half - 0.5) < 0.012 and abs(eighth - 0.125) < 0.012 and none is None


def test_memoised_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    got = u.memoised(df, ["k"], "twice", F.col("k") * 2).orderBy("v").collect()
    assert [r.twice for r in got] == [2, 2, None, 4]


def test_filter_on_a_bound_literal_is_not_copied(spark):
    df = spark.createDataFrame([("N(0,1)",), ("bad",)], "x string")
    bound = let(df, d=u.parse(F.col("x"))).where(u.less_than(u.from_struct(F.col("d")), 0.5) > 0.5)
    plan = bound._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert "regexp_extract" not in condition
    assert bound.count() == 1


def test_fuzzy(spark):
    a, b = F.lit(0.3), F.lit(0.8)
    got = spark.range(1).select(u.fuzzy_and(a, b), u.fuzzy_or(a, b), u.fuzzy_implies(a, b), u.fuzzy_not(a), u.fuzzy_and(a, F.lit(None).cast("double"))).first()
    assert got[:4] == pytest.approx((0.3, 0.8, 0.8, 0.7)) and got[4] is None
