"""Aggregates of the SQL dialect where they differ from Spark's own, and list-valued series functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum; 0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def _of_one(x: Column, value: Column) -> Column:
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(value)


def variance(x: Column, population: bool = False) -> Column:
    """0 over one value, for either kind."""
    return _of_one(x, F.var_pop(x) if population else F.var_samp(x))


def stddev(x: Column, population: bool = False) -> Column:
    return _of_one(x, F.stddev_pop(x) if population else F.stddev_samp(x))


def percentile(x: Column, q: float) -> Column:
    """Linear at position q * (n + 1), held within the ends; the median at q = 0.5. The values of a group are sorted in one array."""
    v = F.sort_array(F.collect_list(x.cast("double")))
    n = F.size(v)
    pos = F.lit(q) * (n + 1)
    low = F.floor(pos).cast("int")
    inside = F.element_at(v, F.greatest(F.lit(1), F.least(low, n)))
    above = F.element_at(v, F.greatest(F.lit(1), F.least(low + 1, n)))
    return F.when(n == 0, F.lit(None)).when(pos < 1, F.element_at(v, 1)).when(pos >= n, F.element_at(v, -1)).otherwise(inside + (pos - low) * (above - inside))


def modes(x: Column) -> Column:
    """All values that are most frequent, sorted."""
    return F.sort_array(_most(F.collect_list(x)))


def _most(v: Column) -> Column:
    kinds = F.array_distinct(v)
    counted = F.transform(kinds, lambda k: F.struct(F.size(F.filter(v, lambda y: y == k)).alias("n"), k.alias("k")))
    top = F.array_max(F.transform(counted, lambda c: c["n"]))
    return F.transform(F.filter(counted, lambda c: c["n"] == top), lambda c: c["k"])


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_true(x: Column) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(True))


# series: aggregates over rows ordered by a time


def _series(ts: Column, *x: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(ts.alias("t"), *[c.alias(f"v{i}") for i, c in enumerate(x)])))


def ts_first(x: Column, ts: Column) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), ts))


def ts_last(x: Column, ts: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), ts))


def ts_delta(x: Column, ts: Column) -> Column:
    """Last less first; 0 of one sample."""
    return ts_last(x, ts) - ts_first(x, ts)


def ts_rate(x: Column, ts: Column) -> Column:
    """Change a second between the first and the last sample; null of fewer than two, or of no time."""
    span = (F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / F.lit(1e6)
    return F.when((F.count(x) > 1) & (span != 0), ts_delta(x, ts) / span)


def ts_lag(x: Column, ts: Column, n: int = 1) -> Column:
    """List, by time, of the value n rows before each."""
    return _shifted(_series(ts, x), -n)


def ts_lead(x: Column, ts: Column, n: int = 1) -> Column:
    return _shifted(_series(ts, x), n)


def _shifted(s: Column, n: int) -> Column:
    return F.transform(s, lambda row, i: F.when((i + n >= 0) & (i + n < F.size(s)), F.get(s, i + n)["v0"]))


def ts_moving_avg(x: Column, ts: Column, window: int) -> Column:
    """List, by time, of the mean of each row and up to window - 1 before it."""
    s = _series(ts, x)
    v = F.transform(s, lambda r: r["v0"])
    part = lambda i: F.slice(v, F.greatest(F.lit(1), i + 2 - window), F.least(i + 1, F.lit(window)))
    return F.transform(v, lambda _, i: F.aggregate(part(i), F.lit(0.0), lambda a, b: a + b) / F.size(part(i)))


def ts_correlate(x: Column, y: Column) -> Column:
    return F.corr(x, y)


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the interval of so many seconds, from the epoch on, that holds ts."""
    size = seconds * 1_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / size) * size).cast("long"))
