"""The registered queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import algorithms as G
from ..operators import search
from ..operators.pattern import Graph, Match, paths, traverse
from ..sources.tables import table
from ..storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> Graph:
    t = lambda n: table(spark, d, n)
    return Graph(
        {"Customer": (t("customer"), "c_custkey"), "Order": (t("orders"), "o_orderkey"), "Part": (t("part"), "p_partkey"), "Supplier": (t("supplier"), "s_suppkey"), "Nation": (t("nation"), "n_nationkey"), "Region": (t("region"), "r_regionkey")},
        {"PLACED": (t("orders"), "o_custkey", "o_orderkey"), "CONTAINS": (t("lineitem"), "l_orderkey", "l_partkey"), "SUPPLIED_BY": (t("lineitem"), "l_orderkey", "l_suppkey"), "LIVES_IN": (t("customer"), "c_custkey", "c_nationkey"), "BASED_IN": (t("supplier"), "s_suppkey", "s_nationkey"), "PART_OF": (t("nation"), "n_nationkey", "n_regionkey")},
        {"PLACED": ("Customer", "Order"), "CONTAINS": ("Order", "Part"), "SUPPLIED_BY": ("Order", "Supplier"), "LIVES_IN": ("Customer", "Nation"), "BASED_IN": ("Supplier", "Nation"), "PART_OF": ("Nation", "Region")},
        {"PLACED": ("o_orderkey",), "CONTAINS": ("l_orderkey", "l_linenumber"), "SUPPLIED_BY": ("l_orderkey", "l_linenumber"), "LIVES_IN": ("c_custkey",), "BASED_IN": ("s_suppkey",), "PART_OF": ("n_nationkey",)},
    )


# patterns


@query("SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def match_hop(spark, d):
    m = Match.node(graph(spark, d), "c", "Customer").hop("c", "PLACED", "o", alias="r")
    return m.rows.groupBy(F.col("c_.c_mktsegment").alias("seg")).agg(F.count("*").alias("n"), F.round(F.sum("r_.o_totalprice"), 2).alias("total"))


@query("SELECT r_name AS region, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1")
def match_chain(spark, d):
    g = graph(spark, d)
    m = Match.node(g, "c", "Customer").hop("c", "PLACED", "o", where=F.col("o_orderstatus") == "F").hop("c", "LIVES_IN", "n").hop("n", "PART_OF", "r").read("r", "Region")
    return m.rows.groupBy(F.col("r_.r_name").alias("region")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY 1")
def match_optional(spark, d):
    m = Match.node(graph(spark, d), "c", "Customer").hop("c", "PLACED", "o", where=F.col("o_totalprice") > 200000, optional=True)
    return m.rows.groupBy("c").agg(F.count("o").alias("n"))


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def match_not_exists(spark, d):
    return Match.node(graph(spark, d), "c", "Customer").exists("c", "PLACED", negate=True).rows.select("c")


@query("SELECT s_suppkey AS s, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY 1")
def match_expand_into(spark, d):
    """A cycle: the supplier is based where the customer lives, so the last hop leads to a bound node."""
    m = Match.node(graph(spark, d), "c", "Customer").hop("c", "PLACED", "o").hop("o", "SUPPLIED_BY", "s").hop("c", "LIVES_IN", "n").hop("s", "BASED_IN", "n")
    return m.rows.groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT c_custkey + 1000, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 5002, 0")
def traverse_breadth_first(spark, d):
    down = table(spark, d, "nation").select((F.col("n_regionkey") + 5000).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    down = down.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst")))
    return traverse(down, spark.createDataFrame([(5002,)], "id long"), 3).select(F.col("id").cast("long"), "depth")


_BOUGHT = "SELECT DISTINCT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def bought(spark: SparkSession, d: str) -> DataFrame:
    """All customers that ordered, and the parts they ordered, as one bipartite graph."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    held = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return held.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


@query("""WITH RECURSIVE e AS (SELECT l_orderkey * 2 AS o, l_partkey * 2 + 1 AS p, l_orderkey * 8 + l_linenumber AS id FROM lineitem), b AS (SELECT o AS src, p AS dst, id FROM e UNION ALL SELECT p, o, id FROM e),
p AS (SELECT src AS first, dst AS last, [id] AS rels FROM b UNION ALL SELECT p.first, b.dst, list_append(p.rels, b.id) FROM p JOIN b ON b.src = p.last WHERE len(p.rels) < 2 AND NOT list_contains(p.rels, b.id))
SELECT len(rels) AS length, count(*) AS n, sum(last) AS ends FROM p GROUP BY 1""")
def variable_length_paths(spark, d):
    """Trails of one or two hops along the lines between orders and parts, in either direction, from all of them."""
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id"))
    p = paths(both, both.select(F.col("src").alias("id")).distinct(), 1, 2)
    return p.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.element_at("nodes", -1)).alias("ends"))


# algorithms


@query(f"WITH e AS ({_BOUGHT}) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def algo_degree(spark, d):
    return G.degree(bought(spark, d))


_BOTH = f"e AS ({_BOUGHT}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _wcc_sql(rounds: int) -> str:
    """The least label of the neighbours, so many times; of these graphs no two nodes of a component are farther apart."""
    steps = [_BOTH.replace("AS (", "AS MATERIALIZED ("), "l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS c FROM b)"]
    steps += [f"l{i + 1} AS MATERIALIZED (SELECT l.node, least(any_value(l.c), min(m.c)) AS c FROM l{i} l JOIN b ON b.src = l.node JOIN l{i} m ON m.node = b.dst GROUP BY 1)" for i in range(rounds)]
    return f"WITH {', '.join(steps)} SELECT node, c AS component FROM l{rounds}"


@query(_wcc_sql(12))
def algo_wcc(spark, d):
    return G.connected_components(bought(spark, d))


_FLOWS = "SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"
_TRI = f"SELECT src, dst FROM ({_FLOWS}) WHERE n * (SELECT count(*) FROM ({_FLOWS})) > (SELECT sum(n) FROM ({_FLOWS}))"


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations that sell more lines to a nation than two nations do on average, counted over all lines: a graph of the nations, for what has a row a pair of nodes."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    flows = written(j.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n")))
    return flows.crossJoin(F.broadcast(flows.agg(F.count("*").alias("pairs"), F.sum("n").alias("total")))).filter("n * pairs > total").select("src", "dst")  # one row


_MARKET = "SELECT DISTINCT * FROM (SELECT o_custkey * 3 AS src, l_partkey * 3 + 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem UNION ALL SELECT l_suppkey * 3 + 2, o_custkey * 3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def market_lines(spark: SparkSession, d: str) -> DataFrame:
    """market() with an edge as often as lines have it, for what takes parallel edges as one."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = (F.col("o_custkey") * 3, F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 3 + 2)
    three = F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in zip(ends, (*ends[1:], ends[0]), strict=True)])
    return lines.select(F.explode(three).alias("e")).select("e.*")


def market(spark: SparkSession, d: str) -> DataFrame:
    """All customers, parts and suppliers that stand in a line, each line a triangle of a customer to a part to its supplier to the customer."""
    return market_lines(spark, d).distinct()


_SUPPLY = "SELECT DISTINCT * FROM (SELECT c_nationkey * 4 AS src, c_custkey * 4 + 1 AS dst FROM customer UNION ALL SELECT o_custkey * 4 + 1, o_orderkey * 4 + 2 FROM orders UNION ALL SELECT l_orderkey * 4 + 2, l_partkey * 4 + 3 FROM lineitem)"


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Nations to all their customers, to all their orders, to all their parts: a graph without cycles."""
    t = lambda n, a, x, b, y: table(spark, d, n).select((F.col(a).cast("long") * 4 + x).alias("src"), (F.col(b).cast("long") * 4 + y).alias("dst"))
    return t("customer", "c_nationkey", 0, "c_custkey", 1).unionByName(t("orders", "o_custkey", 1, "o_orderkey", 2)).unionByName(t("lineitem", "l_orderkey", 2, "l_partkey", 3)).distinct()


def _tables(edges: str) -> str:
    return f"e AS MATERIALIZED ({edges}), b AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), deg AS MATERIALIZED (SELECT src AS node, count(*) AS n FROM b GROUP BY 1)"


_TB, _MB = _tables(_TRI), _tables(_MARKET)


@query(f"WITH {_MB}, t AS (SELECT x.src AS node, count(*) AS n2 FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src WHERE x.dst < y.dst GROUP BY 1) SELECT node, coalesce(n2, 0) AS triangles, round(CASE WHEN n < 2 THEN 0.0 ELSE 2.0 * coalesce(n2, 0) / (n * (n - 1)) END, 9) AS coefficient FROM deg LEFT JOIN t USING (node)")
def algo_triangle_count(spark, d):
    return G.triangles(market_lines(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


def _rank_sql(rounds: int) -> str:
    steps = [f"e AS MATERIALIZED ({_MARKET})", "v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "o AS (SELECT src, count(*) AS n_out FROM e GROUP BY 1)", "r0 AS (SELECT node, n_out, 1.0::DOUBLE / (SELECT count(*) FROM v) AS score FROM v LEFT JOIN o ON src = node)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node, n_out, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM r{i} WHERE n_out IS NULL) / (SELECT count(*) FROM v)) AS score FROM r{i} LEFT JOIN (SELECT dst, sum(score / n_out) AS got FROM e JOIN r{i} ON node = src GROUP BY 1) ON dst = node)")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM r{rounds}"


@query(_rank_sql(8))
def algo_page_rank(spark, d):
    return G.page_rank(market(spark, d), 8, tolerance=0.0).withColumn("score", F.round("score", 9))


@query(f"WITH {_MB}, own AS (SELECT dst AS via FROM b WHERE src = 3), m AS (SELECT b.dst AS node, count(*) AS common, sum(CASE WHEN deg.n > 1 THEN 1 / ln(deg.n) ELSE 0 END) AS aa, sum(1.0 / deg.n) AS ra FROM own JOIN b ON b.src = via JOIN deg ON deg.node = via WHERE b.dst <> 3 GROUP BY 1) SELECT m.node, common, round(common / (n + (SELECT count(*) FROM own) - common), 9) AS jaccard, round(aa, 9) AS adamic_adar, round(ra, 9) AS resource, n * (SELECT count(*) FROM own) AS preferential FROM m JOIN deg ON deg.node = m.node")
def algo_neighbour_scores(spark, d):
    out = G.neighbour_scores(market(spark, d), 3)
    return out.select("node", "common", *[F.round(c, 9).alias(c) for c in ("jaccard", "adamic_adar", "resource")], "preferential")


@query()
def algo_k_core(spark, d):
    return G.k_core(bought(spark, d))


@query()
def algo_label_propagation(spark, d):
    return G.label_propagation(bought(spark, d), 4)


def _shortest_sql(rounds: int) -> str:
    """So many rounds of relaxation, which is more than any shortest path of these graphs has edges."""
    steps = [_BOTH.replace("AS (", "AS MATERIALIZED ("), "w AS MATERIALIZED (SELECT src, dst, CAST((src + dst) % 7 + 1 AS DOUBLE) AS weight FROM b)", "s0 AS MATERIALIZED (SELECT min(src) AS node, 0.0::DOUBLE AS cost FROM b)"]
    steps += [f"s{i + 1} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT * FROM s{i} UNION ALL SELECT w.dst, s.cost + w.weight FROM s{i} s JOIN w ON w.src = s.node) GROUP BY 1)" for i in range(rounds)]
    return f"WITH {', '.join(steps)} SELECT node, cost FROM s{rounds}"


@query(_shortest_sql(24))
def algo_shortest_paths(spark, d):
    both = written(G.undirected(bought(spark, d)))
    weighted = both.withColumn("weight", ((F.col("src") + F.col("dst")) % 7 + 1).cast("double"))
    return G.shortest_distances(weighted, both.agg(F.min("src")).first()[0])


# aggregation and predicates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_by(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(A.total(F.col("l_quantity")), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT c_nationkey, round(CASE WHEN count(c_acctbal) = 1 THEN 0.0 ELSE var_samp(c_acctbal) END, 3) AS var, round(CASE WHEN count(c_acctbal) = 1 THEN 0.0 ELSE stddev_pop(c_acctbal) END, 5) AS sd, coalesce(bool_or(c_acctbal > 9000), false) AS any_rich, coalesce(bool_and(c_acctbal > -900), true) AS all_ok FROM customer GROUP BY 1")
def statistics(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(A.variance(x), 3).alias("var"), F.round(A.stddev(x, True), 5).alias("sd"), A.any_true(x > 9000).alias("any_rich"), A.all_true(x > -900).alias("all_ok"))


@query("""WITH v AS (SELECT s_nationkey AS k, list_sort(list(s_acctbal)) AS v, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT *, 0.25 * (n + 1) AS pos FROM v)
SELECT k, round(CASE WHEN pos < 1 THEN v[1] WHEN pos >= n THEN v[n] ELSE v[CAST(floor(pos) AS INT)] + (pos - floor(pos)) * (v[CAST(floor(pos) AS INT) + 1] - v[CAST(floor(pos) AS INT)]) END, 6) AS p25 FROM p""")
def percentile(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(A.percentile(F.col("s_acctbal"), 0.25), 6).alias("p25"))


@query("WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, max(n) AS top FROM c GROUP BY 1) SELECT c.p_brand, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS modes FROM c JOIN m ON c.p_brand = m.p_brand AND n = top GROUP BY 1")
def mode(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(A.modes(F.col("p_size")).cast("array<string>"), ",").alias("modes"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def top_skip_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT p_partkey, (p_type LIKE '%STEEL%') AS steel, (p_name ILIKE 'a%') AS a, p_size BETWEEN 10 AND 20 AS mid, p_brand IN ('Brand#11', 'Brand#23') AS brands, NOT ((NULLIF(p_size, 7) = 5) IS TRUE) AS not_five, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part")
def predicates(spark, d):
    size = F.nullif(F.col("p_size"), F.lit(7))
    return table(spark, d, "part").select("p_partkey", P.like(F.col("p_type"), "%STEEL%").alias("steel"), P.like(F.col("p_name"), "a%", ignore_case=True).alias("a"), P.between(F.col("p_size"), F.lit(10), F.lit(20)).alias("mid"), P.is_in(F.col("p_brand"), ["Brand#11", "Brand#23"]).alias("brands"), P.ne(size, F.lit(5)).alias("not_five"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("kind"))


@query("SELECT o_orderpriority AS p, word FROM (SELECT DISTINCT o_orderpriority FROM orders), unnest(string_split(o_orderpriority, '-')) AS t(word)")
def unwind_distinct(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().select("p", F.explode_outer(F.split("p", "-")).alias("word"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region")
def union_distinct(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


@query("SELECT c_custkey, upper(left(c_name, 1)) || substr(c_name, 2) AS cap, levenshtein(c_name, c_mktsegment) AS lev, md5(c_name) AS md5, round(floor(c_acctbal + 0.5), 1) AS r, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS sig, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, sign(c_acctbal) AS sgn FROM customer")
def scalars(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", S.capitalize(F.col("c_name")).alias("cap"), F.levenshtein("c_name", "c_mktsegment").cast("long").alias("lev"), F.md5("c_name").alias("md5"), S.round_half_up(x).alias("r"), F.round(S.sigmoid(x / 1000), 9).alias("sig"), S.slug(F.col("c_name")).alias("slug"), F.signum(x).cast("byte").alias("sgn"))


@query("SELECT user_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(user_id % 90 - event_id % 90) / 2), 2) + cos(radians(event_id % 90)) * cos(radians(user_id % 90)) * pow(sin(radians(user_id % 180 - event_id % 180) / 2), 2))), 3) AS m FROM events WHERE event_id % 90 BETWEEN 10 AND 20")
def geo_distance(spark, d):
    e = table(spark, d, "events").withColumn("lat", F.col("event_id") % 90).withColumn("lon", F.col("event_id") % 180)
    e = e.filter(S.within_box(F.col("lat"), F.col("lon"), 10, 0, 20, 180))
    return e.select("user_id", F.round(S.distance_m(F.col("lat"), F.col("lon"), F.col("user_id") % 90, F.col("user_id") % 180), 3).alias("m"))


# time series


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def time_buckets(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", A.time_bucket(F.col("t"), 3600).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events WHERE value IS NOT NULL GROUP BY 1")
def series_first_last(spark, d):
    at = F.struct("ts", "event_id")
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(A.ts_first(v, at).alias("first"), A.ts_last(v, at).alias("last"), F.round(A.ts_delta(v, at), 6).alias("delta"))


@query("WITH l AS (SELECT event_type, event_id, lag(value) OVER w AS p, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, round(sum(p), 4) AS lag_sum, round(sum(m), 4) AS mov_sum FROM l WHERE event_id IS NOT NULL GROUP BY 1")
def series_lag_moving(spark, d):
    """Rows of a type are one series: windows rather than lists, which a long series doesn't fit."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", F.lag("value").over(w).alias("p"), F.avg("value").over(w.rowsBetween(-4, 0)).alias("m"))
    return e.groupBy("event_type").agg(F.round(F.sum("p"), 4).alias("lag_sum"), F.round(F.sum("m"), 4).alias("mov_sum"))


@query("SELECT event_type, round(corr(value, user_id), 9) AS r FROM events GROUP BY 1")
def series_correlate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(A.ts_correlate(F.col("value"), F.col("user_id").cast("double")), 9).alias("r"))


# vectors and text


_Q = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6) AS distance FROM embeddings ORDER BY list_distance(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), vec_id LIMIT 10")
def vector_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    target = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    return search.nearest(e, "vec_id", "embedding", target, 10).withColumn("distance", F.round("distance", 6))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(list_max(list_transform(v, lambda x: abs(x))), 9) AS linf, CAST(len(list_filter(v, lambda x: x > 0)) AS INT) AS ones FROM v")
def vector_norms(spark, d):
    v = V.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude(v), 6).alias("norm"), F.round(V.l1_norm(v), 6).alias("l1"), F.round(V.linf_norm(v), 9).alias("linf"), F.aggregate(V.quantize_binary(v), F.lit(0), lambda s, x: s + x).alias("ones"))


@query("WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS norm FROM c GROUP BY 1")
def vector_centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    return e.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'idiot')) AS t1, len(list_filter(w, lambda x: x = 'clown')) AS t2 FROM w),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM b)
SELECT doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM b, s WHERE t1 > 0 OR t2 > 0""")
def full_text(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ["idiot", "clown"]).withColumn("score", F.round("score", 6))


from . import change_queries, cypher_queries, dialect_queries, function_queries, graph_queries, value_queries  # noqa: E402, F401  they register themselves
