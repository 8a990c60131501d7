"""Solutions algebra. A solution is a row, a variable a column, unbound is NULL.

Shared variables that may be unbound on the left are named in ``maybe``, on the right in
``maybe_right`` (by default the same). Which of them a row binds is a code, and a row is keyed once
for every code the other side may have, so one equi-join over one pass of each side finds all
compatible pairs. Rows without a key left are spread over slices: no nested loop over NULLs, and no
broadcast of a side of unknown size.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadtide.operators.patterns import conjunction, join_solutions

#: Parts in which the left rows without a key are joined; every part sees all right rows without one.
SLICES = 32


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _sides(left: DataFrame, right: DataFrame, maybe: list[str] | None, maybe_right: list[str] | None):
    """Shared variables, and which of them may be unbound on the left and on the right."""
    shared = _shared(left, right)
    on_left = [c for c in maybe or [] if c in shared]
    on_right = on_left if maybe_right is None else [c for c in maybe_right if c in shared]
    return shared, on_left, on_right


def _keyed(df: DataFrame, keys: list[str], own: list[str], other: list[str], side: str, bare: bool = False, met: bool = False) -> DataFrame:
    """Rows with key columns, a copy for every set of variables the other side may lack.

    ``own`` and ``other`` are the keys that this and the other side may lack. ``bare`` leaves the key
    columns only, each combination once. ``met`` drops copies that have no key left.
    """
    code = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(own)], F.lit(0))
    out = df.withColumn(f"{side}own", code)
    codes = F.explode(F.sequence(F.lit(0), F.lit((1 << len(other)) - 1))) if other else F.lit(0)
    out = out.withColumn(f"{side}other", codes)

    def lacking(c: str) -> Column:
        return F.col(f"{side}other").bitwiseAND(F.lit(1 << other.index(c))) != 0

    out = out.withColumns({f"{side}k_{c}": F.when(~lacking(c), F.col(c)) if c in other else F.col(c) for c in keys})
    unkeyed = F.lit(True)
    for c in keys:
        unkeyed = unkeyed & ((F.col(c).isNull() if c in own else F.lit(False)) | (lacking(c) if c in other else F.lit(False)))
    out = out.withColumn(f"{side}unkeyed", unkeyed)
    if met:
        out = out.where(~F.col(f"{side}unkeyed"))
    if bare:
        out = out.select(*[c for c in out.columns if c.startswith(side)]).distinct()
    if any(c not in own and c not in other for c in keys):
        part = F.lit(0)  # there is always a key
    elif side == "__l_":
        part = F.pmod(F.xxhash64(*df.columns), F.lit(SLICES)).cast("int") if df.columns else F.lit(0)
        part = F.when(F.col(f"{side}unkeyed"), part).otherwise(0)
    else:
        every = F.sequence(F.lit(0), F.lit(SLICES - 1))
        part = F.explode(F.when(F.col(f"{side}unkeyed"), every).otherwise(F.array(F.lit(0))))
    return out.withColumn(f"{side}part", part)


def _on(keys: list[str], maybe: list[str]) -> Column:
    on = (F.col("__l_own") == F.col("__r_other")) & (F.col("__l_other") == F.col("__r_own")) & (F.col("__l_part") == F.col("__r_part"))
    for c in keys:
        l, r = F.col(f"__l_k_{c}"), F.col(f"__r_k_{c}")
        on = on & (l.eqNullSafe(r) if c in maybe else l == r)
    return on


def join(left: DataFrame, right: DataFrame, maybe: list[str] | None = None, maybe_right: list[str] | None = None) -> DataFrame:
    """Compatible solutions of both sides."""
    shared, on_left, on_right = _sides(left, right, maybe, maybe_right)
    if not on_left and not on_right:
        return join_solutions(left, right)
    loose = [*on_left, *on_right]
    l = _keyed(left, shared, on_left, on_right, "__l_")
    r = _keyed(right, shared, on_right, on_left, "__r_").withColumnsRenamed({c: f"__v_{c}" for c in shared})
    filled = [F.coalesce(F.col(c), F.col(f"__v_{c}")).alias(c) if c in loose else F.col(c) for c in left.columns]
    return l.join(r, _on(shared, loose), "inner").select(*filled, *[c for c in right.columns if c not in shared])


def _against(
    left: DataFrame, right: DataFrame, keys: list[str], loose: list[str], how: str, condition: Column | None = None, met: bool = False
) -> DataFrame:
    """Left rows, which may lack ``loose`` keys, with right rows that have all of them.

    In the condition a key means the right side's value, which is the merged one; the left side's goes
    by ``__v_`` and the name.
    """
    bare = condition is None and how in ("left_anti", "left_semi")
    l = _keyed(left, keys, loose, [], "__l_").withColumnsRenamed({c: f"__v_{c}" for c in keys})
    r = _keyed(right, keys, [], loose, "__r_", bare and set(keys) == set(loose), met)
    on = _on(keys, loose)
    return l.join(r, on if condition is None else on & condition, how)


def _filtered(left, right, shared, on_left, unbound, how, condition=None, met=False) -> DataFrame:
    """Left rows with or without a partner among the right rows that lack exactly ``unbound``."""
    keys = [c for c in shared if c not in unbound]
    kept = _against(left, right.drop(*unbound), keys, [c for c in keys if c in on_left], how, condition, met)
    return kept.select(*[F.col(f"__v_{c}").alias(c) if c in keys else F.col(c) for c in left.columns])


def _by_unbound(df: DataFrame, maybe: list[str]):
    """The table by which of the variables are unbound, with those."""
    for flags in product((False, True), repeat=len(maybe)):
        part = df
        for c, missing in zip(maybe, flags):
            part = part.where(F.col(c).isNull() if missing else F.col(c).isNotNull())
        yield part, [c for c, missing in zip(maybe, flags) if missing]


def optional(
    left: DataFrame, right: DataFrame, condition: Column | None = None, maybe: list[str] | None = None,
    maybe_right: list[str] | None = None,
) -> DataFrame:
    """Left join; ``condition`` is the filter inside the OPTIONAL and may use both sides."""
    shared, on_left, on_right = _sides(left, right, maybe, maybe_right)
    if on_right:
        both = join(left, right, on_left, on_right)
        both = both if condition is None else both.where(condition)
        return both.unionByName(_lacking(left, right, shared, on_left, on_right, condition), allowMissingColumns=True)
    if shared and not on_left and condition is None:
        return left.join(right, shared, "left")
    found = _against(left, right, shared, on_left, "left", condition)
    own = [F.coalesce(F.col(f"__v_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    return found.select(*own, *[c for c in right.columns if c not in shared])


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; a variable one side lacks is unbound there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _lacking(left, right, shared, on_left, on_right, condition=None, met=False) -> DataFrame:
    for part, unbound in _by_unbound(right, on_right):
        left = _filtered(left, part, shared, on_left, unbound, "left_anti", condition, met)
    return left


def not_exists(left: DataFrame, right: DataFrame, maybe: list[str] | None = None, maybe_right: list[str] | None = None) -> DataFrame:
    """Left solutions without a compatible right solution."""
    shared, on_left, on_right = _sides(left, right, maybe, maybe_right)
    if not on_left and not on_right:
        return _anti(left, right, shared)
    return _lacking(left, right, shared, on_left, on_right)


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return left.join(right.select(*keys), keys, "left_anti")
    return left.join(right.limit(1).select(F.lit(True).alias("__any")), F.col("__any"), "left_anti")


def _semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return left.join(right.select(*keys), keys, "left_semi")
    return left.join(right.limit(1).select(F.lit(True).alias("__any")), F.col("__any"), "left_semi")


def exists(left: DataFrame, right: DataFrame, maybe: list[str] | None = None, maybe_right: list[str] | None = None) -> DataFrame:
    """Left solutions with a compatible right solution."""
    shared, on_left, on_right = _sides(left, right, maybe, maybe_right)
    if not on_left and not on_right:
        return _semi(left, right, shared)
    out = []
    for part, unbound in _by_unbound(right, on_right):
        out.append(_filtered(left, part, shared, on_left, unbound, "left_semi"))
        left = _filtered(left, part, shared, on_left, unbound, "left_anti")
    return reduce(DataFrame.unionByName, out)


def minus(left: DataFrame, right: DataFrame, maybe: list[str] | None = None, maybe_right: list[str] | None = None) -> DataFrame:
    """Drop left solutions compatible with a right one that shares at least one bound variable."""
    shared, on_left, on_right = _sides(left, right, maybe, maybe_right)
    if not shared:
        return left
    if not on_left and not on_right:
        return _anti(left, right, shared)
    return _lacking(left, right, shared, on_left, on_right, met=True)


def values(spark: SparkSession, variables: dict[str, str], rows: list[tuple]) -> DataFrame:
    """Inline data; ``None`` is UNDEF. ``variables`` maps names to types."""
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in variables.items()))


def join_values(left: DataFrame, inline: DataFrame, rows: list[tuple]) -> DataFrame:
    """Join with inline data; only the UNDEF columns pay for NULL tolerance."""
    undef = [c for i, c in enumerate(inline.columns) if any(r[i] is None for r in rows)]
    return join(left, inline, [], undef)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """BIND: a new variable; an expression error leaves it unbound."""
    if name in df.columns:
        raise ValueError(f"{name} is already bound")
    return df.withColumn(name, value)


def let_(df: DataFrame, name: str, value: Column) -> DataFrame:
    """LET: bind a new variable, or keep the rows where the bound one is equal."""
    return df.where(F.col(name) == value) if name in df.columns else df.withColumn(name, value)


def project(df: DataFrame, *items: str | Column | tuple[str, Column]) -> DataFrame:
    """SELECT of variables, named expressions ``(name, expr)`` and unnamed expressions."""
    out = []
    for i, item in enumerate(items):
        if isinstance(item, tuple):
            out.append(item[1].alias(item[0]))
        elif isinstance(item, str):
            out.append(F.col(item))
        else:
            out.append(item.alias(f"_c{i}"))
    return df.select(*out)


def visible(df: DataFrame) -> DataFrame:
    """SELECT *: every variable of the query, none of the operators' own columns."""
    return df.select(*[c for c in df.columns if not c.startswith("__")])


def group(spark: SparkSession, *parts: DataFrame, filters: list[Column] | None = None) -> DataFrame:
    """A group pattern: conjunction of its parts, then its filters. No parts: one empty solution."""
    out = conjunction(list(parts)) if parts else spark.range(1).select()
    for f in filters or []:
        out = out.where(f)
    return out


def for_each(df: DataFrame, name: str, settings: list[float]) -> DataFrame:
    """Run a parameterised query for several settings of one parameter in a single pass."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in settings])))
