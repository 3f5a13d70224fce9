"""Filter lists in disjunctive normal form, compiled to one Column that Catalyst pushes down."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import quoted

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
}


def _term(term) -> Column:
    try:
        name, operator, value = term
    except (TypeError, ValueError):
        raise ValueError(f"a filter is (column, operator, value), not {term!r}") from None
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; one of {sorted(OPERATORS)}")
    return OPERATORS[operator](F.col(quoted(name)), value)


def dnf_predicate(filters) -> Column | None:
    """[(c, op, v), ...] is AND; [[...], [...]] is OR of ANDs; empty is no filter."""
    if not filters:
        return None
    groups = filters if isinstance(filters[0], list) else [filters]
    return reduce(Column.__or__, [reduce(Column.__and__, map(_term, g)) for g in groups if g])
