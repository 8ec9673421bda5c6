"""Scalar functions of both dialects that Spark lacks under one call, from its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity, as a double."""
    return F.floor(x + 0.5).cast("double")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def prefix(s: Column, p: str) -> Column:
    return F.when(s.startswith(p), s).otherwise(F.concat(F.lit(p), s))


def trim_prefix(s: Column, p: str) -> Column:
    return F.when(s.startswith(p), F.substring(s, len(p) + 1, 2**31 - 1)).otherwise(s)


def trim_suffix(s: Column, p: str) -> Column:
    return F.when(s.endswith(p), F.left(s, F.char_length(s) - len(p))).otherwise(s)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def snake_case(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "_")


def hamming_text(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    size = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(size == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / size)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def within_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
