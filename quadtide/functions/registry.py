"""Functions and aggregates by IRI, looked up while the query is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadtide.functions import uncertainty as u
from quadtide.vocab import UNC, XSD

_FUNCTIONS: dict[str, Callable] = {}
_AGGREGATES: dict[str, Callable[..., Column]] = {}


def register(iri: str, fn: Callable) -> None:
    """A scalar function: columns in, column out. A pandas UDF is one too."""
    _FUNCTIONS[iri] = fn


def register_aggregate(iri: str, fn: Callable[..., Column]) -> None:
    _AGGREGATES[iri] = fn


def call(iri: str, *args):
    """CALL(iri, ...), and any function written as an IRI."""
    if iri not in _FUNCTIONS:
        raise KeyError(f"no function {iri}")
    return _FUNCTIONS[iri](*args)


def aggregate(iri: str, *args) -> Column:
    if iri not in _AGGREGATES:
        raise KeyError(f"no aggregate {iri}")
    return _AGGREGATES[iri](*args)


def names() -> list[str]:
    return sorted(_FUNCTIONS)


for _name, _fn in {
    "lessThan": u.less_than, "greaterThan": u.greater_than, "lessThanOrEqual": u.less_or_equal,
    "greaterThanOrEqual": u.greater_or_equal, "between": u.between, "add": u.add, "subtract": u.subtract,
}.items():
    register(UNC + _name, _fn)

for _name, _type in {
    "integer": "decimal(38,0)", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean",
    "string": "string", "dateTime": "timestamp", "date": "date", "long": "bigint", "int": "int",
}.items():
    register(XSD + _name, lambda x, _type=_type: x.try_cast(_type))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


register_aggregate("http://example.org/agg/geometricMean", geometric_mean)
