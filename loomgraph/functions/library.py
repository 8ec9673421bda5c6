"""The function libraries of both query languages by their names, as native column expressions.

An entry takes the compiler (for the types of its arguments) and the arguments.
Names are in lower case. Maps are maps or structs (the literals of the languages);
a struct's values, if they aren't of one type, become texts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lists as L
from . import scalars as S
from . import text as X
from . import vectors as V

CYPHER: dict[str, Callable[..., Column]] = {}
SQL: dict[str, Callable[..., Column]] = {}
_MILLIS = {"ms": 1, "millis": 1, "milliseconds": 1, "s": 1000, "sec": 1000, "seconds": 1000, "m": 60_000, "min": 60_000, "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000}
_DAY = 86_400_000_000_000


def cypher(*names: str):
    def add(f):
        for n in names:
            CYPHER[n.lower()] = f
        return f

    return add


def sql(*names: str):
    def add(f):
        for n in names:
            SQL[n.lower()] = f
        return f

    return add


def _plain(**functions: Callable[..., Column]) -> dict[str, Callable[..., Column]]:
    """Functions that need no types; double underscores stand for dots."""
    return {k.replace("__", ".").lower(): (lambda q, *a, f=f: f(*a)) for k, f in functions.items()}


# helpers


def as_map(q: Any, v: Column) -> Column:
    t = q.type_of(v)
    if isinstance(t, T.StructType):
        same = len({f.dataType.simpleString() for f in t.fields}) == 1
        cells = [c for f in t.fields for c in (F.lit(f.name), v.getField(f.name) if same else v.getField(f.name).cast("string"))]
        return F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
    return v


def _doubles(v: Column) -> Column:
    return F.filter(v.cast("array<double>"), lambda x: x.isNotNull())


def _unit(unit: Column) -> Column:
    """Milliseconds of a unit's name."""
    table = F.create_map(*[F.lit(x) for pair in _MILLIS.items() for x in pair])
    return table[F.lower(unit)].cast("long")


def _millis(q: Any, v: Column) -> Column:
    """Milliseconds since the epoch of a number, a text of one, a date or a timestamp."""
    if isinstance(q.type_of(v), T.TimestampType | T.DateType | T.TimestampNTZType):
        return F.unix_millis(v.cast("timestamp"))
    return v.cast("long")


def _moment(q: Any, v: Column) -> Column:
    return F.timestamp_millis(_millis(q, v))


_FIELDS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "millisecond": lambda t: F.unix_millis(t) % 1000, "dayOfWeek": lambda t: F.weekday(t) + 1,
    "dayOfYear": F.dayofyear, "weekOfYear": F.weekofyear,
}
_ALSO = {"years": "year", "months": "month", "days": "day", "dayofmonth": "day", "hours": "hour", "minutes": "minute", "seconds": "second", "milliseconds": "millisecond", "millis": "millisecond", "weekday": "dayOfWeek", "week": "weekOfYear"}


def _field(t: Column, name: Column) -> Column:
    out: Any = F
    for shown, f in _FIELDS.items():
        names = [shown.lower(), *[k for k, v in _ALSO.items() if v == shown]]
        out = out.when(F.lower(name).isin(names), f(t).cast("long"))
    return out


# aggregates over lists, and lists


@cypher("agg.statistics")
def statistics(q, v):
    d = _doubles(v)
    n, total = F.size(d), F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    spread = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    some = lambda x: F.when(n > 0, x)
    return F.struct(n.cast("long").alias("count"), F.array_min(d).alias("min"), F.array_max(d).alias("max"), total.alias("sum"), some(mean).alias("mean"), some(spread).alias("stdev"), L.median(d).alias("median"))


@cypher("agg.percentiles")
def percentiles(q, v, at):
    """Linear between the items round position p * (n - 1)."""
    s = F.sort_array(_doubles(v))

    def one(p: Column) -> Column:
        place = p * (F.size(s) - 1)
        low = F.get(s, F.floor(place).cast("int"))
        return low + (place - F.floor(place)) * (F.get(s, F.ceil(place).cast("int")) - low)

    return F.when(F.size(s) == 0, F.array().cast("array<double>")).otherwise(F.transform(at.cast("array<double>"), one))


def _extreme(of):
    def f(q, items, values):
        both = F.arrays_zip(items.alias("i"), values.alias("v"))
        top = of(values)
        return F.struct(F.transform(F.filter(both, lambda x: x.getField("v") == top), lambda x: x.getField("i")).alias("items"), top.alias("value"))

    return f


CYPHER |= {"agg.maxitems": _extreme(F.array_max), "agg.minitems": _extreme(F.array_min)}
CYPHER |= _plain(
    agg__first=lambda v: F.get(F.filter(v, lambda x: x.isNotNull()), F.lit(0)), agg__last=lambda v: F.element_at(F.filter(v, lambda x: x.isNotNull()), -1), agg__nth=lambda v, n: F.when(n >= 0, F.get(v, n.cast("int"))), agg__median=lambda v: L.median(_doubles(v)),
    agg__product=L.product, agg__slice=lambda v, a, b=None: F.slice(v, (a + 1).cast("int"), F.greatest((F.size(v) if b is None else F.least(b, F.size(v))) - a, F.lit(0)).cast("int")),
    coll__toset=F.array_distinct, coll__unionall=F.concat, coll__pairsmin=L.pairs, coll__indexof=lambda v, x: L.index_of(v, x), coll__insert=lambda v, i, x: F.array_insert(v, (i + 1).cast("int"), x),
    coll__remove=lambda v, i, n=None: F.filter(v, lambda _, k: (k < i) | (k >= i + (F.lit(1) if n is None else n))), convert__toset=F.array_distinct, tobooleanlist=lambda v: F.transform(v, lambda x: x.try_cast("boolean")),
    tofloatlist=lambda v: F.transform(v, lambda x: x.try_cast("double")), tostringlist=lambda v: F.transform(v, lambda x: x.cast("string")), tointegerlist=lambda v: F.transform(v, lambda x: integer(x)),
)


@cypher("coll.flatten")
def flatten(q, v, deep=None):
    """One level, or all of them where a second argument is true."""
    out = F.flatten(v)
    while deep is not None and "true" in str(deep).lower() and isinstance(q.type_of(out).elementType, T.ArrayType):
        out = F.flatten(out)
    return out


# conversions


def integer(x: Column) -> Column:
    """A whole number; the whole part of a text of a fraction; null of anything else."""
    return F.coalesce(x.try_cast("long"), x.try_cast("double").cast("long"))


@cypher("convert.toboolean")
def to_boolean(q, x):
    t = q.type_of(x)
    if isinstance(t, T.BooleanType):
        return x
    if isinstance(t, T.NumericType):
        return x != 0
    return F.when(F.lower(x).isin("true", "yes", "1"), True).when(F.lower(x).isin("false", "no", "0"), False)


@cypher("convert.tolist")
def to_list(q, x):
    return x if isinstance(q.type_of(x), T.ArrayType) else F.array(x)


@cypher("convert.tojson")
def to_json(q, x):
    return F.to_json(x) if isinstance(q.type_of(x), T.StructType | T.MapType | T.ArrayType) else F.get_json_object(F.to_json(F.struct(x.alias("v"))), "$.v")


_NAMES = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "ZONED DATETIME", T.TimestampNTZType: "LOCAL DATETIME", T.StructType: "MAP", T.MapType: "MAP"}


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"LIST<{type_name(t.elementType)}{'' if t.containsNull else ' NOT NULL'}>"
    if isinstance(t, T.IntegralType):
        return "INTEGER"
    return "FLOAT" if isinstance(t, T.NumericType) else next((n for k, n in _NAMES.items() if isinstance(t, k)), "ANY")


@cypher("valuetype")
def value_type(q, x):
    return F.when(x.isNull(), F.lit("NULL")).otherwise(F.lit(f"{type_name(q.type_of(x))} NOT NULL"))


CYPHER |= {"convert.tomap": as_map}
CYPHER |= _plain(
    convert__tointeger=integer, convert__tofloat=lambda x: x.try_cast("double"), convert__tostring=lambda x: x.cast("string"), convert__fromjsonlist=lambda s: F.from_json(s, "array<string>"), convert__fromjsonmap=lambda s: F.from_json(s, "map<string,string>"),
    tointegerornull=integer, tofloatornull=lambda x: x.try_cast("double"), tobooleanornull=lambda x: x.try_cast("boolean"), tostringornull=lambda x: x.cast("string"),
    create__uuid=F.uuid, create__uuidbase64=lambda: F.regexp_replace(F.base64(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))), "=+$", ""),
    create__vnode=lambda labels, props=None: F.struct(labels.alias("labels"), (F.lit(None).cast("string") if props is None else props).alias("properties")),
    create__vrelationship=lambda a, kind, b, props=None: F.struct(a.alias("start"), kind.alias("type"), b.alias("end"), (F.lit(None).cast("string") if props is None else props).alias("properties")),
)


# maps


@cypher("map.fromlists")
def map_from_lists(q, keys, values):
    return F.map_from_arrays(keys, values)


@cypher("map.frompairs")
def map_from_pairs(q, pairs):
    """Of lists of a key and a value; the last value of a key stays."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda r: F.get(r, F.lit(0)) == F.get(p, F.lit(0))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.get(p, F.lit(0)).cast("string").alias("key"), F.get(p, F.lit(1)).alias("value"))))


@cypher("map.merge")
def map_merge(q, a, b):
    return L.merge(as_map(q, a), as_map(q, b))


@cypher("map.mergelist")
def map_merge_list(q, v):
    """The last value of a key stays."""
    t = q.type_of(v).elementType
    if isinstance(t, T.StructType):
        return as_map(q, F.element_at(v, -1))
    entries = F.flatten(F.transform(v, F.map_entries))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda r: r.getField("key") == e.getField("key")))
    return F.map_from_entries(last)


@cypher("map.groupby")
def map_group_by(q, v, key):
    """A map of lists, by the value of a key as a text; `null` where there is none."""
    name = str(key._jc.toString()).strip("'")
    own = lambda m: F.coalesce(m[name].cast("string"), F.lit("null"))
    keys = F.array_distinct(F.transform(v, own))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(v, lambda m: own(m) == k)))


def _kept(test):
    return lambda q, m, *a: F.map_filter(as_map(q, m), lambda k, v: test(k, v, *a))


def map_flatten(q, m, by=None):
    """Nested maps (structs) as one map from dotted keys to texts."""
    by = "." if by is None else str(by._jc.toString()).strip("'")
    t = q.type_of(m)
    cells: list[Column] = []

    def walk(v: Column, kind: T.DataType, before: str) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                walk(v.getField(f.name), f.dataType, f"{before}{f.name}{by}")
            else:
                cells.extend((F.lit(before + f.name), v.getField(f.name).cast("string")))

    if not isinstance(t, T.StructType):
        return m
    walk(m, t, "")
    return F.create_map(*cells)


def map_unflatten(q, m, by=None):
    """Dotted keys of a literal map as nested maps (structs)."""
    by = "." if by is None else str(by._jc.toString()).strip("'")
    tree: dict[str, Any] = {}
    for f in q.type_of(m).fields:
        at = tree
        *path, last = f.name.split(by)
        for p in path:
            at = at.setdefault(p, {})
        at[last] = m.getField(f.name)
    made = lambda t: F.struct(*[(made(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return made(tree)


def _values(m: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.try_element_at(m, k))


CYPHER |= {
    "map.removekey": _kept(lambda k, v, x: k != x), "map.removekeys": _kept(lambda k, v, xs: ~F.array_contains(xs, k)), "map.submap": _kept(lambda k, v, xs: F.array_contains(xs, k)),
    "map.clean": _kept(lambda k, v, ks, vs: ~F.array_contains(ks, k) & ~F.coalesce(F.array_contains(vs, v), F.lit(False)) & v.isNotNull()),
    "map.setkey": lambda q, m, k, v: F.map_concat(F.map_filter(as_map(q, m), lambda x, _: x != k), F.create_map(k, v)), "map.values": lambda q, m, ks: _values(as_map(q, m), ks),
    "map.sortedproperties": lambda q, m: F.transform(F.array_sort(F.map_entries(as_map(q, m))), lambda e: F.array(e.getField("key").cast("string"), e.getField("value").cast("string"))),
    "map.keys": lambda q, m: F.map_keys(as_map(q, m)), "map.flatten": map_flatten, "map.unflatten": map_unflatten,
}


# numbers


@cypher("round", "math.round")
def rounded(q, x, places=None, mode=None):
    """To a number of decimal places; halves towards plus infinity with one argument, away from zero with two, else by the mode's name."""
    if places is None:
        return S.round_half_up(x)
    if mode is None:
        return F.call_function("round", x.cast("double"), places.cast("int"))
    scale = F.pow(F.lit(10.0), places)
    y = x.cast("double") * scale
    whole, half = F.floor(F.abs(y)), F.abs(y) - F.floor(F.abs(y))
    away = F.signum(y) * F.ceil(F.abs(y))
    nearest = lambda tie: F.signum(y) * F.when(half > 0.5, whole + 1).when(half < 0.5, whole).otherwise(tie)
    m = F.upper(mode)
    return (
        F.when(m == "UP", away).when(m == "DOWN", F.signum(y) * whole).when(m == "CEILING", F.ceil(y)).when(m == "FLOOR", F.floor(y))
        .when(m == "HALF_DOWN", nearest(whole)).when(m == "HALF_EVEN", nearest(whole + whole % 2)).otherwise(nearest(whole + 1)) / scale
    )


@cypher("number.format")
def number_format(q, x, pattern=None):
    """By the two patterns that Spark formats: grouping with a number of decimals. A pattern's decimals are those after its point; trailing # are dropped."""
    shown = "#,##0.###" if pattern is None else str(pattern._jc.toString()).strip("'")
    decimals = shown.partition(".")[2]
    fixed, most = decimals.count("0"), len(decimals)
    out = F.format_number(F.bround(x.cast("double"), most), most)
    if "," not in shown:
        out = F.replace(out, F.lit(","), F.lit(""))
    return out if fixed == most else F.regexp_replace(out, rf"(\.\d{{{fixed}}}\d*?)0+$" if fixed else r"\.?0+$", "$1" if fixed else "")


CYPHER |= _plain(
    math__sinh=F.sinh, math__cosh=F.cosh, math__tanh=F.tanh, math__coth=lambda x: 1 / F.tanh(x), math__sech=lambda x: 1 / F.cosh(x), math__csch=lambda x: 1 / F.sinh(x), math__sigmoid=S.sigmoid, math__sigmoidprime=lambda x: S.sigmoid(x) * (1 - S.sigmoid(x)),
    math__maxlong=lambda: F.lit(2**63 - 1), math__minlong=lambda: F.lit(-(2**63)), math__maxdouble=lambda: F.lit(1.7976931348623157e308), math__mindouble=lambda: F.lit(4.9e-324), math__logit=lambda x: F.log(x / (1 - x)), math__sign=lambda x: F.signum(x).cast("long"),
)


# texts


_QUOTED = lambda d: F.concat(F.lit("\\Q"), d, F.lit("\\E"))


def _of_words(f):
    return lambda s: F.array_join(F.transform(F.split(s, " "), f), " ")


def hamming_distance(a: Column, b: Column) -> Column:
    """Places that differ; null of texts of different lengths."""
    return F.when(F.char_length(a) == F.char_length(b), F.when(F.char_length(a) == 0, 0).otherwise(S.hamming_text(a, b))).cast("long")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity from 0 to 1: characters matched in order within half the longer length, transpositions, and a bonus for up to four common first ones."""
    x, y = F.split(a, ""), F.split(b, "")
    m, n = F.char_length(a), F.char_length(b)
    reach = F.greatest(F.floor(F.greatest(m, n) / 2) - 1, F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("left"))

    def step(s: Column, e: Column) -> Column:
        i, c = e.getField("i"), e.getField("c")
        places = F.filter(F.sequence(F.greatest(F.lit(0), i - reach).cast("int"), F.least(n - 1, i + reach).cast("int")), lambda j: (F.get(y, j) == c) & ~F.array_contains(s.getField("taken"), j))
        hit = F.when(F.greatest(F.lit(0), i - reach) <= F.least(n - 1, i + reach), F.get(places, F.lit(0)))
        return F.when(hit.isNull(), s).otherwise(F.struct(F.array_append(s.getField("taken"), hit).alias("taken"), F.array_append(s.getField("left"), c).alias("left")))

    found = F.aggregate(F.transform(x, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), start, step)
    left = found.getField("left")
    right = F.transform(F.array_sort(found.getField("taken")), lambda j: F.get(y, j))
    k = F.size(left).cast("double")
    swapped = F.size(F.filter(F.zip_with(left, right, lambda p, r: p != r), lambda t: t)) / 2
    jaro = F.when(k == 0, 0.0).otherwise((k / m + k / n + (k - F.floor(swapped)) / k) / 3)
    same = F.zip_with(F.slice(x, 1, 4), F.slice(y, 1, 4), lambda p, r: p == r)
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, t: F.struct((s.getField("n") + F.when(s.getField("on") & F.coalesce(t, F.lit(False)), 1).otherwise(0)).alias("n"), (s.getField("on") & F.coalesce(t, F.lit(False))).alias("on"))).getField("n")
    return F.when(a == b, 1.0).when((m == 0) | (n == 0), 0.0).otherwise(jaro + common * 0.1 * (1 - jaro))


@cypher("text.hexvalue")
def hex_value(q, x):
    """Of a number its digits, of a text four for each of its UTF-16 units."""
    return F.lower(F.hex(x.cast("long"))) if isinstance(q.type_of(x), T.NumericType) else F.lower(F.hex(F.encode(x, "UTF-16BE")))


CYPHER |= _plain(
    text__bytecount=X.byte_count, text__camelcase=X.camel_case, text__capitalize=S.capitalize, text__capitalizeall=X.capitalize_all, text__charat=lambda s, i: F.when((i >= 0) & (i < F.char_length(s)), F.substring(s, i + 1, F.lit(1))), text__code=F.ascii,
    text__decapitalize=X.decapitalize, text__decapitalizeall=_of_words(lambda w: X.decapitalize(w)), text__format=lambda f, *a: F.call_function("format_string", f, *a), text__hammingdistance=hamming_distance, text__indexof=lambda s, t: (F.instr(s, t) - 1).cast("long"),
    text__jarowinklerdistance=jaro_winkler, text__join=lambda v, d: F.call_function("array_join", v.cast("array<string>"), d), text__levenshteindistance=lambda a, b: F.levenshtein(a, b).cast("long"), text__levenshteinsimilarity=S.levenshtein_similarity,
    text__lpad=lambda s, n, c: F.when(F.char_length(s) >= n, s).otherwise(F.call_function("lpad", s, n.cast("int"), c)), text__rpad=lambda s, n, c: F.when(F.char_length(s) >= n, s).otherwise(F.call_function("rpad", s, n.cast("int"), c)),
    text__random=lambda n, chars=None: F.call_function("randstr", n.cast("int")), text__regexreplace=lambda s, p, r: F.regexp_replace(s, p, r), text__replace=F.replace, text__slug=S.slug, text__snakecase=S.snake_case, text__sorensendicesimilarity=X.sorensen_dice,
    text__split=lambda s, d: F.split(s, _QUOTED(d)), text__uppercamelcase=X.upper_camel_case, text__swapcase=lambda s: F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))), ""),
    text__upper=F.upper, text__lower=F.lower, text__trim=F.trim, text__reverse=F.reverse, text__length=lambda s: F.char_length(s).cast("long"), util__md5=lambda x: F.md5(x.cast("string")), util__sha1=lambda x: F.sha1(x.cast("string")), util__sha256=lambda x: F.sha2(x.cast("string"), 256),
    util__sha512=lambda x: F.sha2(x.cast("string"), 512), util__validate=lambda test, message: F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")),
)


def _python(kind: str):
    """A function of columns from one of Python values, run on Arrow batches: what Spark has no expression for."""

    def made(f):
        import pandas as pd

        def call(q, *args: Column) -> Column:
            def run(*cols):
                return pd.Series([None if x[0] is None else f(*x) for x in zip(*cols, strict=True)], dtype=object)

            return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*args)

        return call

    return made


@cypher("util.compress")
@_python("string")
def compress(x, how="gzip"):
    import base64
    import gzip
    import zlib

    data = str(x).encode()
    return base64.b64encode(gzip.compress(data, mtime=0) if how == "gzip" else zlib.compress(data)).decode()


@cypher("util.decompress")
@_python("string")
def decompress(x, how="gzip"):
    import base64
    import gzip
    import zlib

    data = base64.b64decode(x)
    return (gzip.decompress(data) if how == "gzip" else zlib.decompress(data)).decode()


@cypher("normalize")
@sql("normalize")
@_python("string")
def normalize(x, form="NFC"):
    import unicodedata

    return unicodedata.normalize(form, x)


@cypher("isnormalized")
@_python("boolean")
def is_normalized(x, form="NFC"):
    import unicodedata

    return unicodedata.is_normalized(form, x)


@cypher("util.sleep")
def sleep(q, ms):
    import time

    time.sleep(float(str(ms._jc.toString())) / 1000)
    return F.lit(None).cast("string")


# dates: date.* work on milliseconds since the epoch, in the session's time zone


_ISO = "yyyy-MM-dd'T'HH:mm:ss"


@cypher("date.fields")
def date_fields(q, s, pattern=None, zone=None):
    t = F.to_timestamp(s) if pattern is None else F.call_function("to_timestamp", s, pattern)
    return F.struct(*[f(t).cast("long").alias(n) for n, f in _FIELDS.items()], (F.current_timezone() if zone is None else zone).alias("timezone"))


@cypher("date.parse")
def date_parse(q, s, pattern=None, zone=None):
    t = F.to_timestamp(s) if pattern is None else F.call_function("to_timestamp", s, pattern)
    return F.unix_millis(t if zone is None else F.to_utc_timestamp(t, zone))


@cypher("date.format")
def date_format(q, t, pattern=None, zone=None):
    at = _moment(q, t)
    at = at if zone is None else F.from_utc_timestamp(at, zone)
    return F.call_function("date_format", at, F.lit(_ISO) if pattern is None else pattern)


CYPHER |= {
    "date.add": lambda q, t, n, unit: _millis(q, t) + n.cast("long") * _unit(unit), "date.field": lambda q, t, name: _field(_moment(q, t), name), "date.toiso8601": lambda q, t: F.date_format(F.to_utc_timestamp(_moment(q, t), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    "format": lambda q, t, pattern=None: F.call_function("date_format", t, F.lit(_ISO) if pattern is None else pattern),
}
CYPHER |= _plain(
    date__convert=lambda n, a, b: F.call_function("div", n.cast("long") * _unit(a), _unit(b)), date__currenttimestamp=lambda: F.unix_millis(F.current_timestamp()), date__systemtimezone=F.current_timezone, date__fromiso8601=lambda s: F.unix_millis(F.to_timestamp(s)),
    timestamp=lambda: F.unix_millis(F.current_timestamp()), datetime__fromepoch=lambda s, n: F.timestamp_micros(s.cast("long") * 1_000_000 + F.call_function("div", n.cast("long"), F.lit(1000).cast("long"))), datetime__fromepochmillis=lambda n: F.timestamp_millis(n.cast("long")),
    datetime__truncate=lambda u, t: F.call_function("date_trunc", u, t), localdatetime__truncate=lambda u, t: F.call_function("date_trunc", u, t).cast("timestamp_ntz"), date__truncate=lambda u, t: F.call_function("date_trunc", u, t).cast("date"),
)


@cypher("localdatetime")
def local_datetime(q, v=None):
    return F.localtimestamp() if v is None else v.cast("timestamp_ntz")


def _nanos(q, v=None):
    """Nanoseconds of the day of a text hh:mm[:ss[.fraction]], a map of hour, minute, second, nanosecond, or a timestamp; of now."""
    if v is None:
        v = F.localtimestamp()
    t = q.type_of(v)
    if isinstance(t, T.StructType):
        held = {f.name: v.getField(f.name).cast("long") for f in t.fields}
        part = lambda n: held.get(n, F.lit(0).cast("long"))
        return ((part("hour") * 60 + part("minute")) * 60 + part("second")) * 1_000_000_000 + part("millisecond") * 1_000_000 + part("microsecond") * 1000 + part("nanosecond")
    if isinstance(t, T.StringType):
        clock = F.regexp_extract(v, r"^(\d\d):?(\d\d)?:?(\d\d)?", 0)
        digits = F.rpad(F.regexp_replace(clock, ":", ""), 6, "0")
        fraction = F.rpad(F.regexp_extract(v, r"\.(\d+)", 1), 9, "0").cast("long")
        part = lambda a: F.substring(digits, a, 2).cast("long")
        return F.when(clock != "", ((part(1) * 60 + part(3)) * 60 + part(5)) * 1_000_000_000 + fraction)
    return (F.hour(v) * 3600 + F.minute(v) * 60 + F.second(v)).cast("long") * 1_000_000_000 + F.unix_micros(v.cast("timestamp")) % 1_000_000 * 1000


def _time_truncate(q, unit, v):
    n = v if isinstance(q.type_of(v), T.IntegralType) else _nanos(q, v)
    size = F.create_map(*[F.lit(x) for p in {"day": _DAY, "hour": _DAY // 24, "minute": _DAY // 1440, "second": 10**9, "millisecond": 10**6, "microsecond": 1000, "nanosecond": 1}.items() for x in p])[F.lower(unit)].cast("long")
    return n - n % size


CYPHER |= {"localtime": _nanos, "time": _nanos, "localtime.truncate": _time_truncate, "time.truncate": _time_truncate}


def _span(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), seconds.cast("long").alias("seconds"), nanos.cast("long").alias("nanos"))


@cypher("duration")
def duration(q, v):
    """Months, days, seconds and nanoseconds of an ISO 8601 text or of a map of years, months, weeks, days, hours, minutes, seconds."""
    t = q.type_of(v)
    if isinstance(t, T.StructType):
        held = {f.name: v.getField(f.name).cast("double") for f in t.fields}
        part = lambda n: held.get(n, F.lit(0.0))
    else:
        def part(n: str) -> Column:
            mark, clock = {"years": ("Y", False), "months": ("M", False), "weeks": ("W", False), "days": ("D", False), "hours": ("H", True), "minutes": ("M", True), "seconds": ("S", True)}.get(n, ("", False))
            if not mark:
                return F.lit(0.0)
            side = F.regexp_extract(v, r"T(.*)$", 1) if clock else F.regexp_extract(v, r"^-?P([^T]*)", 1)
            return F.coalesce(F.nullif(F.regexp_extract(side, rf"(-?[\d.]+){mark}", 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = part("hours") * 3600 + part("minutes") * 60 + part("seconds")
    return _span(part("years") * 12 + part("months"), part("weeks") * 7 + part("days"), F.floor(seconds), F.round((seconds - F.floor(seconds)) * 1e9) + part("nanoseconds"))


def _months(a: Column, b: Column) -> Column:
    """Whole months from a to b, towards zero."""
    return F.when(b >= a, F.floor(F.months_between(b, a, False))).otherwise(-F.floor(F.months_between(a, b, False))).cast("long")


def _between(q, a, b):
    a, b = a.cast("timestamp"), b.cast("timestamp")
    m = _months(a, b)
    rest = F.unix_micros(b) - F.unix_micros(F.call_function("try_add", a, F.make_ym_interval(F.lit(0), m.cast("int"))))
    days = F.when(rest >= 0, F.floor(rest / 86_400_000_000)).otherwise(F.ceil(rest / 86_400_000_000)).cast("long")
    micros = rest - days * 86_400_000_000
    seconds = F.floor(micros / 1_000_000).cast("long")
    return _span(m, days, seconds, (micros - seconds * 1_000_000) * 1000)


_NONE = lambda: F.lit(0)
CYPHER |= {
    "duration.between": _between, "duration.inmonths": lambda q, a, b: _span(_months(a.cast("timestamp"), b.cast("timestamp")), _NONE(), _NONE(), _NONE()),
    "duration.indays": lambda q, a, b: _span(_NONE(), F.call_function("div", F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")), F.lit(86_400_000_000)), _NONE(), _NONE()),
    "duration.inseconds": lambda q, a, b: _span(_NONE(), _NONE(), F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000), F.pmod(F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")), F.lit(1_000_000)) * 1000),
}


# points: structs of x, y, z, crs, srid


@cypher("point")
def point(q, m):
    held = {f.name.lower(): m.getField(f.name) for f in q.type_of(m).fields}
    on_earth = "latitude" in held or "longitude" in held
    x, y, z = (held.get(a, held.get(b)) for a, b in (("longitude", "x"), ("latitude", "y"), ("height", "z")))
    crs = ("wgs-84" if on_earth else "cartesian") + ("-3d" if z is not None else "")
    srid = {"wgs-84": 4326, "wgs-84-3d": 4979, "cartesian": 7203, "cartesian-3d": 9157}[crs]
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if z is None else z).cast("double").alias("z"), F.lit(crs).alias("crs"), F.lit(srid).alias("srid"))


@cypher("point.distance", "distance")
def point_distance(q, a, b):
    """Metres along a great circle for longitudes and latitudes, else the straight distance; null of different systems."""
    flat = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(F.coalesce(a["z"] - b["z"], F.lit(0.0)), 2))
    return F.when(a["srid"] != b["srid"], F.lit(None).cast("double")).when(a["crs"].startswith("wgs"), S.distance_m(a["y"], a["x"], b["y"], b["x"])).otherwise(flat)


@cypher("point.withinbbox")
def point_within(q, p, low, high):
    return F.when((p["srid"] == low["srid"]) & (p["srid"] == high["srid"]), p["x"].between(low["x"], high["x"]) & p["y"].between(low["y"], high["y"]))


# vectors


def _d(v: Column) -> Column:
    return V.doubles(v)


def _metric(a: Column, b: Column, metric: Column | None = None) -> Column:
    x, y = _d(a), _d(b)
    m = F.lit("EUCLIDEAN") if metric is None else F.upper(metric)
    l2 = V.l2_distance(x, y)
    return (
        F.when(m == "EUCLIDEAN_SQUARED", l2 * l2).when(m == "MANHATTAN", V.l1_distance(x, y)).when(m == "COSINE", 1 - V.cosine(x, y)).when(m == "DOT", -V.dot(x, y))
        .when(m == "HAMMING", V.hamming(x, y).cast("double")).otherwise(l2)
    )


def _variance(v: Column) -> Column:
    x = _d(v)
    mean = V.mean(x)
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean)) / F.size(x)


def quantize_int8(v: Column) -> Column:
    """Bytes of a vector scaled from its least to its greatest element, with both."""
    x = _d(v)
    low, high = F.array_min(x), F.array_max(x)
    scaled = F.transform(x, lambda y: F.when(high == low, 0).otherwise(F.round((y - low) / (high - low) * 255 - 128)).cast("int"))
    return F.struct(scaled.alias("quantized"), low.alias("min"), high.alias("max"))


def dequantize_int8(v: Column, low: Column | None = None, high: Column | None = None) -> Column:
    x, a, b = (v["quantized"], v["min"], v["max"]) if low is None else (v, low, high)
    return F.transform(x, lambda y: (y + 128) / 255.0 * (b - a) + a)


def sparse(indices: Column, values: Column, size: Column | None = None) -> Column:
    return F.struct(indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"), (F.array_max(indices) + 1 if size is None else size).cast("int").alias("size"))


def to_sparse(v: Column, least: Column | None = None) -> Column:
    kept = F.filter(F.transform(_d(v), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: F.abs(e["x"]) > (F.lit(0.0) if least is None else least))
    return F.struct(F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["x"]).alias("values"), F.size(v).alias("size"))


def to_dense(s: Column) -> Column:
    place = lambda i: F.array_position(s["indices"], i).cast("int")
    return F.when(s["size"] == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(s["size"], F.lit(1)) - 1), lambda i: F.coalesce(F.when(place(i) > 0, F.get(s["values"], place(i) - 1)), F.lit(0.0))))


def sparse_dot(a: Column, b: Column) -> Column:
    of = lambda s: F.map_from_arrays(s["indices"], s["values"])
    return F.aggregate(F.array_intersect(a["indices"], b["indices"]), F.lit(0.0), lambda t, i: t + of(a)[i] * of(b)[i])


def rrf(*ranks: Column, k: int = 60) -> Column:
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return out


def normalize_scores(v: Column) -> Column:
    x = _d(v)
    low, high = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda y: F.when(high == low, 1.0).otherwise((y - low) / (high - low)))


def multi_score(v: Column, how: Column, weights: Column | None = None) -> Column:
    x = _d(v)
    w = F.transform(x, lambda _: F.lit(1.0)) if weights is None else _d(weights)
    weighed = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) / F.aggregate(w, F.lit(0.0), lambda s, y: s + y)
    m = F.upper(how)
    return F.when(m == "MAX", F.array_max(x)).when(m == "MIN", F.array_min(x)).when(m == "AVG", V.mean(x)).when(m == "SUM", V.mean(x) * F.size(x)).otherwise(weighed)


def score_transform(x: Column, how: Column) -> Column:
    y, m = x.cast("double"), F.upper(how)
    return F.when(m == "LINEAR", y).when(m == "SIGMOID", S.sigmoid(y)).when(m == "LOG", F.log(y)).when(m == "EXP", F.exp(y)).when(m == "SQRT", F.sqrt(y)).when(m == "INVERSE", 1 / y)


def _scaled(v: Column, k: Column) -> Column:
    return F.transform(_d(v), lambda x: x * k)


def _clip(v: Column, low: Column, high: Column) -> Column:
    return F.transform(_d(v), lambda x: F.greatest(low.cast("double"), F.least(high.cast("double"), x)))


def _sparsity(v: Column, least: Column | None = None) -> Column:
    return F.size(F.filter(_d(v), lambda x: F.abs(x) <= (F.lit(0.0) if least is None else least))) / F.size(v)


_VECTORS = _plain(
    vector__add=lambda a, b: V.add(_d(a), _d(b)), vector__subtract=lambda a, b: V.subtract(_d(a), _d(b)), vector__multiply=lambda a, b: V.multiply(_d(a), _d(b)), vector__scale=_scaled, vector__clip=_clip, vector__normalize=lambda v: V.normalize(_d(v)),
    vector__magnitude=lambda v: V.magnitude(_d(v)), vector__l1norm=lambda v: V.l1_norm(_d(v)), vector__linfnorm=lambda v: V.linf_norm(_d(v)), vector__dotproduct=lambda a, b: V.dot(_d(a), _d(b)), vector__cosinesimilarity=lambda a, b: V.cosine(_d(a), _d(b)),
    vector__l2distance=lambda a, b: V.l2_distance(_d(a), _d(b)), vector__quantizebinary=lambda v: V.quantize_binary(_d(v)), vector__sparsity=_sparsity, vector__dimension=lambda v: F.size(v).cast("long"), vector__hasnan=lambda v: F.exists(_d(v), lambda x: F.isnan(x)),
    vector__hasinf=lambda v: F.exists(_d(v), lambda x: F.abs(x) == float("inf")), vector__hasnull=lambda v: F.exists(v, lambda x: x.isNull()), vector__isnormalized=lambda v, t=None: F.abs(V.magnitude(_d(v)) - 1) <= (F.lit(0.001) if t is None else t), vector__variance=_variance,
    vector__stddev=lambda v: F.sqrt(_variance(v)), vector__quantizeint8=quantize_int8, vector__dequantizeint8=dequantize_int8, vector__dequantizebinary=lambda v, a=None, b=None: F.transform(v, lambda x: F.when(x == 1, F.lit(1.0) if b is None else b).otherwise(F.lit(-1.0) if a is None else a)),
    vector__approxdistance=lambda a, b, kind=None: V.hamming(a, b).cast("double") if kind is None else F.when(F.upper(kind) == "BINARY", V.hamming(a, b).cast("double")).otherwise(V.l2_distance(_d(a), _d(b))), vector__sparsecreate=sparse, vector__densetosparse=to_sparse,
    vector__sparsetodense=to_dense, vector__sparsedot=sparse_dot, vector__rrfscore=rrf, vector__hybridscore=lambda a, b, w: w * a + (1 - w) * b, vector__normalizescores=normalize_scores, vector__multiscore=multi_score, vector__scoretransform=score_transform,
    vector__tostring=lambda v, f=None: F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ", "), F.lit("]")),
)
SQL |= _VECTORS
CYPHER |= _VECTORS | _plain(
    vector=lambda v, n=None: v.cast("array<float>"), vector_create=lambda v, n=None: v.cast("array<float>"), vector_dimension_count=lambda v: F.size(v).cast("long"), vector_distance=_metric, vector_distance_cosine=lambda a, b: _metric(a, b, F.lit("COSINE")),
    vector_distance_euclidean=lambda a, b: _metric(a, b), vector_distance_manhattan=lambda a, b: _metric(a, b, F.lit("MANHATTAN")), vector__distance__euclidean=lambda a, b: _metric(a, b), vector__norm=lambda v: V.magnitude(_d(v)),
    vector__similarity__cosine=lambda a, b: (1 + V.cosine(_d(a), _d(b))) / 2, vector__similarity__euclidean=lambda a, b: 1 / (1 + F.pow(V.l2_distance(_d(a), _d(b)), 2)), vector_norm=lambda v, metric=None: V.magnitude(_d(v)),
)


# the SQL dialect's own


@sql("ifempty")
def if_empty(q, x, y):
    t = q.type_of(x)
    empty = F.size(x) == 0 if isinstance(t, T.ArrayType | T.MapType) else F.length(x.cast("string")) == 0
    return F.when(empty, y).otherwise(x)


SQL |= _plain(
    pow=F.pow, power=F.pow, encode=lambda x, f: F.when(F.lower(f) == "base64", F.base64(F.encode(x, "UTF-8"))).otherwise(F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_")), strcmpci=lambda a, b: X.compare_ignoring_case(a, b),
    decode=lambda x, f: F.decode(F.when(F.lower(f) == "base64", F.unbase64(x)).otherwise(F.unbase64(F.translate(x, "-_", "+/"))), "UTF-8"), format=lambda f, *a: F.call_function("format_string", f, *a), version=F.version,
    duration=lambda n, unit: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * _unit(unit) / 1000).cast("decimal(18,6)")), map=lambda *a: F.create_map(*a),
)
SQL |= {"eval": lambda q, s: F.expr(str(s._jc.toString()).strip("'"))}
