"""Pieces of oracle SQL: distribution functions written out for an engine without ``erf``."""

from __future__ import annotations


def phi(x: str) -> str:
    """Normal distribution function by the Hart approximation."""
    z = f"abs({x})"
    num = "0.0352624965998911"
    for c in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        num = f"({num}*{z}+{c})"
    den = "0.0883883476483184"
    for c in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"):
        den = f"({den}*{z}+{c})"
    far = f"({z}+1/({z}+2/({z}+3/({z}+4/({z}+0.65)))))"
    e = f"exp(-{z}*{z}/2)"
    tail = f"(CASE WHEN {z} < 7 THEN {e}*{num}/{den} ELSE {e}/{far}/2.5066282746310002 END)"
    return f"(CASE WHEN {x} > 0 THEN 1-{tail} ELSE {tail} END)"


def density(x: str) -> str:
    return f"(exp(-({x})*({x})/2)/2.5066282746310002)"


def cdf(kind: str, a: str, b: str, k: str) -> str:
    return (
        f"(CASE {kind} WHEN 'N' THEN {phi(f'((({k})-({a}))/sqrt({b}))')} "
        f"WHEN 'U' THEN least(greatest((({k})-({a}))/(({b})-({a})),0.0),1.0) END)"
    )


def less_uu(a: str, b: str, c: str, d: str) -> str:
    """P(X < Y), X uniform on (a,b), Y uniform on (c,d)."""

    def area(y: str) -> str:
        return f"(CASE WHEN {y} < {a} THEN 0 WHEN {y} <= {b} THEN ({y}-{a})*({y}-{a})/(2*({b}-{a})) ELSE ({b}-{a})/2+({y}-{b}) END)"

    return f"(({area(d)}-{area(c)})/({d}-{c}))"


def less_nn(m1: str, v1: str, m2: str, v2: str) -> str:
    return phi(f"((({m2})-({m1}))/sqrt(({v1})+({v2})))")


def less_nu(m: str, v: str, c: str, d: str) -> str:
    """P(X < Y), X normal, Y uniform on (c,d)."""

    def area(y: str) -> str:
        z = f"(({y}-{m})/sqrt({v}))"
        return f"({z}*{phi(z)}+{density(z)})"

    return f"(sqrt({v})*({area(d)}-{area(c)})/({d}-{c}))"


def parsed(text: str, prefix: str = "") -> str:
    """Select-list items kind, a, b of a distribution literal, NULL when invalid."""
    num = r"\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*"
    pat = rf"^([NU])\({num},{num}\)$"

    def part(i: int) -> str:
        return f"regexp_extract({text}, '{pat}', {i})"

    a, b = f"TRY_CAST({part(2)} AS DOUBLE)", f"TRY_CAST({part(3)} AS DOUBLE)"
    valid = f"(({part(1)}='N' AND {b} > 0) OR ({part(1)}='U' AND {a} < {b}))"
    return (
        f"CASE WHEN {valid} THEN {part(1)} END AS {prefix}kind, "
        f"CASE WHEN {valid} THEN {a} END AS {prefix}a, CASE WHEN {valid} THEN {b} END AS {prefix}b"
    )


def ticks(every_hours: int, tail_hours: int) -> str:
    """A table of evaluation times over the events."""
    return (
        "(SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), "
        f"(SELECT max(ts) FROM events) + INTERVAL {tail_hours} HOUR, INTERVAL {every_hours} HOUR)) AS tick)"
    )


def upper(step_hours: int, tick: str = "tick") -> str:
    """Exclusive upper bound of a window whose origin is the first day."""
    ref = "(SELECT epoch_us(date_trunc('day', min(ts))) FROM events)"
    step = step_hours * 3600 * 1000000
    return f"make_timestamp(epoch_us({tick}) - ((epoch_us({tick}) - {ref}) % {step}))"
