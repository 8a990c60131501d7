"""Probability distributions as three columns, and closed-form comparisons between them.

A distribution literal is ``N(mean,variance)`` or ``U(lower,upper)``. Everything here is Column
arithmetic, so it stays inside generated code. Expression errors are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Margin used by strict comparisons against a number.
EPSILON = 1e-7

NORMAL = "N"
UNIFORM = "U"
POINT = "K"

STRUCT_TYPE = "struct<kind:string,a:double,b:double>"

_NUMBER = r"\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*"

# Hart's rational approximation of the normal tail (published in 1968), highest
# power first. Absolute error is below 1e-15.
_TAIL_NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


Params = tuple[Column, Column]


@dataclass(frozen=True)
class Uncertain:
    """A random value: the parameters it has if it is of a given kind, and which kind it is.

    ``kind`` is a plain string where it is known when the query is written. Keeping the parameters
    per kind lets every formula use them without a CASE around each operand.
    """

    kind: Column | str
    params: dict[str, Params]

    def kind_column(self) -> Column:
        return F.lit(self.kind) if isinstance(self.kind, str) else self.kind

    def known(self, kind: str) -> bool:
        return isinstance(self.kind, str) and self.kind == kind

    def pick(self, options: dict[str, Column]) -> Column:
        """The option of the actual kind; NULL for a kind that has none."""
        if isinstance(self.kind, str):
            return options.get(self.kind, F.lit(None).cast("double"))
        chain = F
        for name, expr in options.items():
            chain = chain.when(self.kind == name, expr)
        return chain if options else F.lit(None).cast("double")

    @property
    def a(self) -> Column:
        return self.pick({k: p[0] for k, p in self.params.items()})

    @property
    def b(self) -> Column:
        return self.pick({k: p[1] for k, p in self.params.items()})

    def valid(self) -> Column:
        rules = {k: KINDS[k].valid(*p) if k in KINDS else p[0].isNotNull() for k, p in self.params.items()}
        return self.pick(rules)

    def struct(self) -> Column:
        """One nullable struct column, NULL where the parameters are not a distribution."""
        return F.when(
            self.valid(),
            F.struct(self.kind_column().alias("kind"), self.a.alias("a"), self.b.alias("b")),
        )

    def text(self) -> Column:
        """Literal text; the inverse of :func:`parse`."""
        body = F.concat(
            self.kind_column(), F.lit("("), self.a.cast("string"), F.lit(", "),
            self.b.cast("string"), F.lit(")"),
        )
        return F.when(self.kind_column() != POINT, body).otherwise(self.a.cast("string"))


@dataclass(frozen=True)
class Kind:
    """What a distribution family has to say: validity, P(X <= k), and shifting by a number.

    ``draw(rng, a, b, n)`` gives ``n`` samples from a numpy generator, where the family can be sampled.
    """

    valid: Callable[[Column, Column], Column]
    cdf: Callable[[Column, Column, Column], Column]
    shift: Callable[[Column, Column, Column], Params]
    args: int = 2
    draw: Callable | None = None


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def phi_density(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def phi(z: Column) -> Column:
    """Standard normal distribution function.

    The ratio tends to 1/(x sqrt(2 pi)) for large x, so one formula serves the whole line.
    """
    x = F.least(F.abs(z), F.lit(40.0))
    tail = F.exp(-x * x / 2.0) * _horner(_TAIL_NUMERATOR, x) / _horner(_TAIL_DENOMINATOR, x)
    return F.signum(z) * (0.5 - tail) + 0.5


def _clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


KINDS: dict[str, Kind] = {
    NORMAL: Kind(
        valid=lambda a, b: a.isNotNull() & (b > 0),
        cdf=lambda a, b, k: phi((k - a) / F.sqrt(b)),
        shift=lambda a, b, k: (a + k, b),
        draw=lambda rng, a, b, n: rng.normal(a, b**0.5, n),
    ),
    UNIFORM: Kind(
        valid=lambda a, b: a < b,
        cdf=lambda a, b, k: _clip01((k - a) / (b - a)),
        shift=lambda a, b, k: (a + k, b + k),
        draw=lambda rng, a, b, n: rng.uniform(a, b, n),
    ),
}


def register_kind(letter: str, kind: Kind) -> None:
    """Add a distribution family under a one-letter name."""
    if len(letter) != 1 or not letter.isalpha() or letter == POINT:
        raise ValueError(f"not a usable distribution letter: {letter!r}")
    KINDS[letter] = kind


def _num(x: Column | float | int) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def point(x: Column | float | int) -> Uncertain:
    """A plain number in a place where a distribution may stand."""
    value = _num(x)
    return Uncertain(POINT, {POINT: (value, value)})


def normal(mean: Column | float, variance: Column | float) -> Uncertain:
    return Uncertain(NORMAL, {NORMAL: (_num(mean), _num(variance))})


def uniform(lower: Column | float, upper: Column | float) -> Uncertain:
    return Uncertain(UNIFORM, {UNIFORM: (_num(lower), _num(upper))})


def from_columns(kind: Column, a: Column, b: Column) -> Uncertain:
    """A random value whose kind is data; kind ``K`` is a plain number."""
    return Uncertain(kind, {k: (a, b) for k in [*KINDS, POINT]})


def from_struct(column: Column) -> Uncertain:
    return from_columns(column["kind"], column["a"], column["b"])


def parse(text: Column) -> Column:
    """Distribution literal text to a struct; NULL where the text names no distribution.

    The text is matched once per field and several times in a pushed-down filter: bind the result
    with :func:`quadtide.functions.binding.let` before filtering on it.
    """
    two = "".join(k for k, rule in KINDS.items() if rule.args == 2)
    out = _parsed(text, rf"^([{two}])\({_NUMBER},{_NUMBER}\)$", 3)
    one = "".join(k for k, rule in KINDS.items() if rule.args == 1)
    if one:
        out = F.coalesce(out, _parsed(text, rf"^([{one}])\({_NUMBER}\)$", 2))
    return out


def _parsed(text: Column, pattern: str, last: int) -> Column:
    kind = F.regexp_extract(text, pattern, 1)
    a = F.regexp_extract(text, pattern, 2).try_cast("double")
    b = F.regexp_extract(text, pattern, last).try_cast("double")
    return Uncertain(kind, {k: (a, b) for k in KINDS}).struct()


def _value(x: Uncertain | Column | float | int) -> Uncertain:
    return x if isinstance(x, Uncertain) else point(x)


def cdf(x: Uncertain, k: Column | float) -> Column:
    """P(X <= k) for a distribution; NULL for a plain number."""
    at = _num(k)
    return x.pick({name: KINDS[name].cdf(*p, at) for name, p in x.params.items() if name in KINDS})


def _less_normal_normal(x: Params, y: Params) -> Column:
    return phi((y[0] - x[0]) / F.sqrt(x[1] + y[1]))


def _less_uniform_uniform(x: Params, y: Params) -> Column:
    width = x[1] - x[0]

    def area(at: Column) -> Column:
        inside = F.least(F.greatest(at - x[0], F.lit(0.0)), width)
        return inside * inside / (2.0 * width) + F.greatest(at - x[1], F.lit(0.0))

    return (area(y[1]) - area(y[0])) / (y[1] - y[0])


def _less_normal_uniform(x: Params, y: Params) -> Column:
    sd = F.sqrt(x[1])

    def area(at: Column) -> Column:
        z = (at - x[0]) / sd
        return z * phi(z) + phi_density(z)

    # Rounding may leave the difference a hair outside the unit interval.
    return _clip01(sd * (area(y[1]) - area(y[0])) / (y[1] - y[0]))


_PAIRS = {
    (NORMAL, NORMAL): _less_normal_normal,
    (UNIFORM, UNIFORM): _less_uniform_uniform,
    (NORMAL, UNIFORM): _less_normal_uniform,
    (UNIFORM, NORMAL): lambda x, y: 1.0 - _less_normal_uniform(y, x),
}


def register_pair(left: str, right: str, less: Callable[[Params, Params], Column]) -> None:
    """Closed form of P(X < Y) for one more pair of families."""
    _PAIRS[(left, right)] = less


def _pairwise(x: Uncertain, y: Uncertain) -> Column:
    by_right = {}
    for right, py in y.params.items():
        options = {
            l: less(x.params[l], py) for (l, r), less in _PAIRS.items() if r == right and l in x.params
        }
        if options:
            by_right[right] = x.pick(options)
    return y.pick(by_right)


def _compare(x, y, against_number: Callable[[Uncertain, Column], Column], against_dist) -> Column:
    x, y = _value(x), _value(y)
    if y.known(POINT):
        return against_number(x, y.params[POINT][0])
    if isinstance(y.kind, str) or POINT not in y.params:
        return against_dist(x, y)
    return F.when(y.kind == POINT, against_number(x, y.params[POINT][0])).otherwise(against_dist(x, y))


def less_than(x, y) -> Column:
    """P(X < Y); ``y`` is a number or a distribution, ``x`` has to be a distribution."""
    return _compare(x, y, lambda d, k: cdf(d, k - EPSILON), _pairwise)


def less_or_equal(x, y) -> Column:
    return _compare(x, y, cdf, _pairwise)


def greater_than(x, y) -> Column:
    return _compare(x, y, lambda d, k: 1.0 - cdf(d, k + EPSILON), lambda d, e: 1.0 - _pairwise(d, e))


def greater_or_equal(x, y) -> Column:
    return _compare(x, y, lambda d, k: 1.0 - cdf(d, k), lambda d, e: 1.0 - _pairwise(d, e))


def between(x, lower: Column | float, upper: Column | float) -> Column:
    """P(lower < X <= upper); NULL where the bounds are the wrong way round."""
    x, lo, hi = _value(x), _num(lower), _num(upper)
    options = {
        name: F.when(lo <= hi, KINDS[name].cdf(*p, hi) - KINDS[name].cdf(*p, lo))
        for name, p in x.params.items() if name in KINDS
    }
    if POINT in x.params:
        at = x.params[POINT][0]
        options[POINT] = ((at > lo) & (at <= hi)).cast("double")
    return x.pick(options)


def _combine(x, y, sign: float) -> Uncertain:
    x, y = _value(x), _value(y)
    params = {}
    for name, p in x.params.items():
        a, b = {}, {}
        if POINT in y.params:
            step = y.params[POINT][0] * F.lit(sign)
            a[POINT], b[POINT] = KINDS[name].shift(*p, step) if name in KINDS else (p[0] + step, p[0] + step)
        if name == NORMAL and NORMAL in y.params:
            a[NORMAL] = p[0] + y.params[NORMAL][0] * F.lit(sign)
            b[NORMAL] = p[1] + y.params[NORMAL][1]
        params[name] = (y.pick(a), y.pick(b))
    return Uncertain(x.kind, params)


def add(x, y) -> Uncertain:
    """X + Y for a shift by a number, two numbers, or two independent normals."""
    return _combine(x, y, 1.0)


def subtract(x, y) -> Uncertain:
    return _combine(x, y, -1.0)


def fuzzy_and(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def fuzzy_or(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def fuzzy_not(a: Column) -> Column:
    return 1.0 - a


def fuzzy_implies(a: Column, b: Column) -> Column:
    return fuzzy_or(1.0 - a, b)


def sampled_less_than(samples: int = 10_000, seed: int = 7):
    """Monte-Carlo P(X < Y) over two distribution structs, for families without a closed form.

    Every family known when this is called can be sampled if it has a ``draw``; a number is itself. The
    generator is seeded from the arguments, so a retried task gives the same number.
    """
    draws = {name: rule.draw for name, rule in KINDS.items() if rule.draw}
    draws[POINT] = lambda rng, a, b, n: np.full(n, a)

    @F.pandas_udf("double")
    def estimate(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        out = []
        for l, r in zip(x.itertuples(index=False), y.itertuples(index=False)):
            if l.kind is None or r.kind is None:
                out.append(None)
                continue
            key = np.frombuffer(np.array([l.a, l.b, r.a, r.b], dtype="float64").tobytes(), dtype="uint32")
            rng = np.random.default_rng([seed, ord(l.kind), ord(r.kind), *key.tolist()])
            if l.kind not in draws or r.kind not in draws:
                out.append(None)
                continue
            left, right = (draws[v.kind](rng, v.a, v.b, samples) for v in (l, r))
            out.append(float((left < right).mean()))
        return pd.Series(out, dtype="float64")

    return estimate


def memoised(df, keys: list[str], name: str, compute: Column):
    """Evaluate an expensive expression once per distinct argument row, then join it back."""
    once = df.select(*keys).distinct().select(*keys, compute.alias(name))
    renamed = once.select(*[F.col(k).alias(f"__memo_{k}") for k in keys], name)
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__memo_{k}"))
        cond = part if cond is None else cond & part
    return df.join(renamed, cond, "left").drop(*[f"__memo_{k}" for k in keys])
