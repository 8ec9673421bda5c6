"""Text functions of both dialects that aren't one call in Spark, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = 2**31 - 1


def index_of(s: Column, part: str) -> Column:
    """Place from 0 on; -1 if it isn't there."""
    return (F.instr(s, part) - 1).cast("long")


def last_index_of(s: Column, part: str) -> Column:
    behind = F.instr(F.reverse(s), part[::-1])
    return F.when(behind == 0, F.lit(-1)).otherwise(F.char_length(s) - behind - len(part) + 1).cast("long")


def char_at(s: Column, at: int) -> Column:
    """The character at a place from 0 on; null beyond the end."""
    return F.when(F.char_length(s) > at, F.substring(s, at + 1, 1))


def capitalize_all(s: Column) -> Column:
    """The first letter of each word, parted by single blanks, in upper case; the rest as it is."""
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, _END))), " ")


def decapitalize(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, _END))


def upper_camel_case(s: Column) -> Column:
    words = F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, _END)))), "")


def camel_case(s: Column) -> Column:
    return decapitalize(upper_camel_case(s))


def byte_count(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def compare_ignoring_case(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a null comes first."""
    x, y = F.lower(a), F.lower(b)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(x == y, 0).when(x < y, -1).otherwise(1)


def _bigrams(s: Column) -> Column:
    low = F.lower(s)
    return F.when(F.char_length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - 1, F.lit(1))), lambda i: low.substr(i, F.lit(2)))))


def sorensen_dice(a: Column, b: Column) -> Column:
    """Twice the shared distinct pairs of characters over the pairs of both; 0 if neither has any."""
    x, y = _bigrams(a), _bigrams(b)
    size = F.size(x) + F.size(y)
    return F.when(size == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / size)
