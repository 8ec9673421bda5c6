"""Registered queries over lists, maps, texts, dates and joins, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import text as X
from ..sources.tables import table
from .queries import query

_LIST = "list(l_linenumber ORDER BY l_linenumber)"


@query(f"""WITH v AS (SELECT l_orderkey, {_LIST} AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(v) AS BIGINT) AS size, v[1] AS head, v[-1] AS last, array_to_string(v[2:], ',') AS tail, array_to_string(list_filter(v, lambda x, i: i <> 2), ',') AS without_second,
CAST(coalesce(list_position(v, 3), 0) - 1 AS BIGINT) AS at, CAST(list_sum(v) AS DOUBLE) AS total, CAST(list_product(v) AS DOUBLE) AS product, list_avg(v) AS mean, list_median(v) AS median, CAST(greatest(len(v) - 1, 0) AS BIGINT) AS pairs FROM v""")
def lists(spark, d):
    v = F.sort_array(F.collect_list("l_linenumber"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    base = table(spark, d, "lineitem").groupBy("l_orderkey").agg(v.alias("v"))
    c = F.col("v")
    return base.select(
        "l_orderkey", F.size(c).cast("long").alias("size"), F.get(c, F.lit(0)).alias("head"), F.element_at(c, -1).alias("last"), joined(L.tail(c)).alias("tail"), joined(L.remove_at(c, 1)).alias("without_second"),
        L.index_of(c, F.lit(3)).alias("at"), L.total(c).alias("total"), L.product(c).alias("product"), L.mean(c).alias("mean"), L.median(c).alias("median"), F.size(L.pairs(c)).cast("long").alias("pairs"),
    )


@query("""WITH v AS (SELECT o_custkey, list(DISTINCT o_orderstatus) FILTER (o_totalprice > 150000) AS a, list(DISTINCT o_orderstatus) FILTER (o_totalprice <= 150000) AS b FROM orders GROUP BY 1), w AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM v)
SELECT o_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, array_to_string(list_sort(list_distinct(a || b)), ',') AS either,
array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)) || list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS one FROM w""")
def set_functions(spark, d):
    dear = F.col("o_totalprice") > 150000
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(dear, F.col("o_orderstatus"))).alias("a"), F.collect_set(F.when(~dear, F.col("o_orderstatus"))).alias("b"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return g.select("o_custkey", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_except("a", "b")).alias("only_a"), joined(F.array_union("a", "b")).alias("either"), joined(L.symmetric_difference(F.col("a"), F.col("b"))).alias("one"))


@query("SELECT p_partkey, p_brand AS brand, CAST(p_size + 1 AS VARCHAR) AS size, 'x' AS added, 3 AS n, 'brand,size,type' AS keys FROM part")
def maps(spark, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    put = L.put(m, "size", (F.col("p_size") + 1).cast("string"))
    more = L.merge(L.pick(m, "brand", "type"), F.create_map(F.lit("added"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", put["brand"].alias("brand"), put["size"].alias("size"), more["added"].alias("added"), F.size(more).alias("n"), F.array_join(F.sort_array(F.map_keys(put)), ",").alias("keys"))


@query("""SELECT p_partkey, CAST(instr(p_type, 'E') - 1 AS BIGINT) AS first_e, CAST(CASE WHEN instr(reverse(p_type), 'E') = 0 THEN -1 ELSE length(p_type) - instr(reverse(p_type), 'E') END AS BIGINT) AS last_e, CASE WHEN length(p_name) > 3 THEN substr(p_name, 4, 1) END AS third,
lower(left(p_type, 1)) || substr(p_type, 2) AS low, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS caps,
array_to_string(list_transform(list_filter(regexp_split_to_array(p_type, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS camel, CAST(strlen(p_name) AS BIGINT) AS bytes,
CASE WHEN lower(p_name) = lower(p_type) THEN 0 WHEN lower(p_name) < lower(p_type) THEN -1 ELSE 1 END AS cmp, lpad(p_brand, 12, '*') AS padded, sha256(p_name) AS sha, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS vowels FROM part""")
def texts(spark, d):
    t, n = F.col("p_type"), F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", X.index_of(t, "E").alias("first_e"), X.last_index_of(t, "E").alias("last_e"), X.char_at(n, 3).alias("third"), X.decapitalize(t).alias("low"), X.capitalize_all(n).alias("caps"), X.upper_camel_case(t).alias("camel"),
        X.byte_count(n).alias("bytes"), X.compare_ignoring_case(n, t).alias("cmp"), F.lpad("p_brand", 12, "*").alias("padded"), F.sha2(n, 256).alias("sha"), F.regexp_replace(t, "[AEIOU]", "_").alias("vowels"),
    )


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_type)), lambda i: lower(p_type)[i:i+1])) AS a, list_distinct(list_transform(range(1, length(p_name)), lambda i: lower(p_name)[i:i+1])) AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS dice FROM g""")
def text_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.sorensen_dice(F.col("p_type"), F.col("p_name")), 9).alias("dice"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, date_trunc('week', o_orderdate) AS week, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(isodow(o_orderdate) AS INT) AS dow,
CAST(epoch(o_orderdate) AS BIGINT) AS secs, o_orderdate + INTERVAL 40 DAY AS later, CAST(datediff('day', o_orderdate, TIMESTAMP '2000-01-01') AS INT) AS days, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders""")
def dates(spark, d):
    """Truncation, fields, durations, parsing and formats."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", t).cast("timestamp_ntz").alias("month"), F.date_trunc("week", t).cast("timestamp_ntz").alias("week"), F.year(t).alias("y"), F.quarter(t).alias("q"), F.dayofyear(t).alias("doy"), (F.weekday(t) + 1).alias("dow"),
        F.unix_timestamp(t.cast("timestamp")).alias("secs"), (t + F.expr("INTERVAL 40 DAY")).alias("later"), F.datediff(F.lit("2000-01-01").cast("date"), t).alias("days"), F.date_format(t, "dd/MM/yyyy").alias("shown"),
    )


@query("""SELECT p_partkey, CAST(p_size & 12 AS INT) AS a, CAST(p_size | 3 AS INT) AS o, CAST(xor(p_size, 5) AS INT) AS x, round(sinh(p_size / 50.0), 9) AS sinh, round(tanh(p_size / 50.0), 9) AS tanh, sign(p_size - 25) AS s, p_size % 7 AS m,
CAST(CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS VARCHAR) AS kind, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, lower(hex(p_partkey)) AS hex FROM part""")
def numbers(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", s.bitwiseAND(12).alias("a"), s.bitwiseOR(3).alias("o"), s.bitwiseXOR(5).alias("x"), F.round(F.sinh(s / 50.0), 9).alias("sinh"), F.round(F.tanh(s / 50.0), 9).alias("tanh"), F.signum(s - 25).cast("int").alias("s"), (s % 7).alias("m"),
        F.when(s < 10, "small").when(s < 30, "mid").otherwise("big").alias("kind"), F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("none")).alias("brand"), F.lower(F.hex("p_partkey")).alias("hex"),
    )


@query("WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM l WHERE k <= 2")
def top_of_each(spark, d):
    """A limit inside a sub-query for each row: the most dear orders of each customer."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("k")).filter("k <= 2").drop("k")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def let_subquery(spark, d):
    """Sub-queries for each row, as one grouping joined back."""
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"))
    return table(spark, d, "customer").select("c_custkey").join(by, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "top", F.coalesce("pending", F.lit(False)).alias("pending"))


@query("SELECT event_type, sum(CASE WHEN p IS NULL OR value < p THEN 0 ELSE 1 END) AS ups, count(*) AS n, max(r) AS last_row, max(k) AS last_rank FROM (SELECT event_type, value, lag(value) OVER w AS p, row_number() OVER w AS r, rank() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) GROUP BY 1")
def series_rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").filter("value is not null").select("event_type", "value", F.lag("value").over(w).alias("p"), F.row_number().over(w).alias("r"), F.rank().over(Window.partitionBy("event_type").orderBy("value")).alias("k"))
    up = F.when(F.col("p").isNull() | (F.col("value") < F.col("p")), 0).otherwise(1)
    return e.groupBy("event_type").agg(F.sum(up).alias("ups"), F.count("*").alias("n"), F.max("r").alias("last_row"), F.max("k").alias("last_rank"))


@query("SELECT label, i AS place, min(x) AS low, max(x) AS high, round(sum(x), 6) AS total FROM (SELECT label, unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i FROM embeddings) GROUP BY 1, 2")
def vector_aggregates(spark, d):
    """Element-wise minimum, maximum and sum of vectors, a row an element, so that no group is held in one list."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "f")).select("label", "place", F.col("f").cast("double").alias("x"))
    return e.groupBy("label", "place").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.sum("x"), 6).alias("total"))
