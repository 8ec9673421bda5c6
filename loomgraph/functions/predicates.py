"""Two-valued predicates of the SQL dialect: a comparison with null is false, and its negation true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    """False where either side is null."""
    return holds(a == b)


def ne(a: Column, b: Column) -> Column:
    """The negation of eq(): true where either side is null."""
    return ~eq(a, b)


def lt(a: Column, b: Column) -> Column:
    return holds(a < b)


def le(a: Column, b: Column) -> Column:
    return holds(a <= b)


def gt(a: Column, b: Column) -> Column:
    return holds(a > b)


def ge(a: Column, b: Column) -> Column:
    return holds(a >= b)


def between(x: Column, low: Column, high: Column) -> Column:
    return holds((x >= low) & (x <= high))


def like(x: Column, pattern: str, *, ignore_case: bool = False) -> Column:
    """% is any run and ? any one character; _ stands for itself. An empty text matches an empty pattern only."""
    out = []
    for c in pattern:
        out.append("%" if c == "%" else "_" if c == "?" else f"\\{c}" if c in "_\\" else c)
    found = x.ilike("".join(out)) if ignore_case else x.like("".join(out))
    return holds(found & ((x != "") | F.lit(pattern == "")))


def matches(x: Column, regex: str) -> Column:
    """The whole text matches the expression."""
    return holds(x.rlike(f"^(?:{regex})$"))


def contains_text(x: Column, part: str) -> Column:
    """Without an index: a substring, case included."""
    return holds(x.contains(part))


def is_in(x: Column, values: list) -> Column:
    return holds(x.isin(values))


def contains_all(items: Column, values: Column) -> Column:
    return holds(F.forall(values, lambda v: F.array_contains(items, v)))


def contains_any(items: Column, values: Column) -> Column:
    return holds(F.arrays_overlap(items, values))
