"""List and map functions of both dialects that aren't one call in Spark, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail(v: Column) -> Column:
    return F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1)))


def insert(v: Column, at: int, x: Column) -> Column:
    """x before the item at place `at`, from 0 on."""
    return F.array_insert(v, at + 1, x)


def remove_at(v: Column, at: int, n: int = 1) -> Column:
    """v without n items from place `at` on."""
    return F.filter(v, lambda x, i: (i < at) | (i >= at + n))


def remove_first(v: Column, x: Column) -> Column:
    """v without the first item that equals x."""
    at = F.array_position(v, x)
    return F.filter(v, lambda _, i: (at == 0) | (i != at - 1))


def index_of(v: Column, x: Column) -> Column:
    """Place of x from 0 on; -1 if it isn't there."""
    return (F.array_position(v, x) - 1).cast("long")


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda s, x: s * F.coalesce(x.cast("double"), F.lit(1.0)))


def mean(v: Column) -> Column:
    """Null of an empty list."""
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def median(v: Column) -> Column:
    """The middle item, or the mean of the two in the middle; null of an empty list."""
    s, n = F.sort_array(v), F.size(v)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def pairs(v: Column) -> Column:
    """Each item with the next one."""
    return F.when(F.size(v) < 2, F.array()).otherwise(F.transform(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda x, i: F.array(x, F.get(v, i + 1))))


def pick(m: Column, *keys: str) -> Column:
    """The map of some keys alone."""
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def drop(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def put(m: Column, key: str, value: Column) -> Column:
    """m with key set to value."""
    return F.map_concat(drop(m, key), F.create_map(F.lit(key), value))


def merge(a: Column, b: Column) -> Column:
    """Both maps; b's value where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
