"""Registered queries written in Cypher, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pattern import Graph
from ..sources.tables import table
from .cypher import cypher
from .queries import _TRI, graph, query, trade


def _text(name: str, text: str, sql: str, **params) -> None:
    def run(spark, d):
        return cypher(graph(spark, d), text, **params)

    run.__name__ = f"cypher_{name}"
    run.__doc__ = text
    query(sql)(run)


_text(
    "match_where",
    "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > $least AND c.c_mktsegment STARTS WITH 'B' RETURN c.c_custkey AS c, o.o_orderkey AS o, o.o_totalprice AS price",
    "SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_mktsegment LIKE 'B%'",
    least=100000,
)
_text(
    "group",
    "MATCH (c:Customer)-[:PLACED]->(o), (c)-[:LIVES_IN]->(n)-[:PART_OF]->(r:Region) WITH r.r_name AS region, count(DISTINCT c) AS customers, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total WHERE orders > 10 RETURN region, customers, orders, total ORDER BY total DESC",
    "SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 10",
)
_text(
    "optional_match",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'P' AND o.o_totalprice > c.c_acctbal RETURN c.c_custkey AS c, count(o) AS n, sum(o.o_totalprice) AS total",
    "SELECT c_custkey AS c, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > c_acctbal GROUP BY 1",
)
_text(
    "inline_properties",
    "MATCH (s:Supplier)-->(n:Nation {n_regionkey: 2}) RETURN n.n_name AS nation, collect(s.s_suppkey)[0] IS NOT NULL AS some, count(*) AS n, min(s.s_acctbal) AS low, max(s.s_acctbal) AS high, avg(s.s_acctbal) > 0 AS rich",
    "SELECT n_name AS nation, true AS some, count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high, avg(s_acctbal) > 0 AS rich FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1",
)
_text(
    "pattern_predicates",
    "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() OR EXISTS { MATCH (c)-[:PLACED]->(o) WHERE o.o_orderstatus = 'P' } RETURN c.c_custkey AS c, COUNT { (c)-[:PLACED]->(:Order) } AS n",
    "WITH g AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT c_custkey AS c, coalesce(n, 0) AS n FROM customer LEFT JOIN g ON o_custkey = c_custkey WHERE n IS NULL OR p",
)
_text(
    "union",
    "MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_nationkey AS nation UNION MATCH (s:Supplier) WHERE s.s_acctbal < 0 RETURN s.s_nationkey AS nation",
    "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
)
_text(
    "labels_and_types",
    "MATCH (a)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN labels(a)[0] AS label, type(r) AS type, n.n_name AS nation, count(*) AS n",
    "SELECT 'Customer' AS label, 'LIVES_IN' AS type, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 3 UNION ALL SELECT 'Supplier', 'BASED_IN', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 3",
)
_text(
    "lists",
    "MATCH (p:Part) WITH p, [x IN range(1, p.p_size % 5 + 1) WHERE x % 2 = 1 | x * 10] AS v RETURN p.p_partkey AS p, size(v) AS n, reduce(t = 0, x IN v | t + x) AS total, v[-1] AS last, any(x IN v WHERE x > 20) AS big, head(v) AS head, size(v[1..]) AS rest, CASE p.p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind, p.p_size / 7 AS whole, toUpper(left(p.p_name, 3)) + '-' + p.p_size AS code",
    """SELECT p_partkey AS p, len(v) AS n, list_sum(v)::BIGINT AS total, v[-1] AS last, list_max(v) > 20 AS big, v[1] AS head, len(v) - 1 AS rest, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind, p_size // 7 AS whole, upper(left(p_name, 3)) || '-' || p_size AS code
FROM (SELECT *, list_transform(list_filter(range(1, p_size % 5 + 2), lambda x: x % 2 = 1), lambda x: x * 10) AS v FROM part)""",
)
_text(
    "unwind",
    "UNWIND ['BUILDING', 'MACHINERY'] AS seg MATCH (c:Customer {c_mktsegment: seg}) RETURN seg, count(*) AS n, stDev(c.c_acctbal) > 0 AS spread, percentileCont(c.c_acctbal, 0.5) AS mid, percentileDisc(c.c_acctbal, 0.9) AS most",
    "SELECT c_mktsegment AS seg, count(*) AS n, stddev_samp(c_acctbal) > 0 AS spread, quantile_cont(c_acctbal, 0.5) AS mid, quantile_disc(c_acctbal, 0.9) AS most FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
)
_text(
    "top",
    "MATCH (c:Customer)-[:PLACED]->(o) WITH c, sum(o.o_totalprice) AS total ORDER BY total DESC, c.c_custkey SKIP 2 LIMIT 10 RETURN c.c_name AS name, round(total, 2) AS total",
    "SELECT c_name AS name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10 OFFSET 2",
)
_text(
    "distinct",
    "MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p:Part) RETURN DISTINCT c.c_mktsegment AS seg, p.p_brand AS brand",
    "SELECT DISTINCT c_mktsegment AS seg, p_brand AS brand FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
)
_text(
    "same_relationship_once",
    "MATCH (a:Part)<-[x:CONTAINS]-(o)-[y:CONTAINS]->(b:Part) WHERE id(a) <= id(b) RETURN id(o) AS o, count(*) AS n",
    "SELECT x.l_orderkey AS o, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <> y.l_linenumber AND x.l_partkey <= y.l_partkey GROUP BY 1",
)


def _trade(spark, d) -> Graph:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name", "n_regionkey")
    return Graph({"Nation": (n, "key")}, {"SELLS_TO": (trade(spark, d), "src", "dst")}, {"SELLS_TO": ("Nation", "Nation")})


_SELLS = f"WITH RECURSIVE f AS MATERIALIZED ({_TRI})"


@query(f"{_SELLS}, p AS (SELECT src AS a, dst AS z, [struct_pack(s := src, d := dst)] AS rels FROM f WHERE src = 3 UNION ALL SELECT a, dst, list_append(rels, struct_pack(s := src, d := dst)) FROM p JOIN f ON src = z WHERE len(rels) < 3 AND NOT list_contains(rels, struct_pack(s := src, d := dst))) SELECT z, len(rels) AS hops, count(*) AS n FROM p WHERE len(rels) >= 2 GROUP BY 1, 2")
def cypher_variable_length(spark, d):
    return cypher(_trade(spark, d), "MATCH q = (a:Nation)-[:SELLS_TO*2..3]->(b) WHERE a.key = 3 RETURN id(b) AS z, length(q) AS hops, count(*) AS n")


@query(f"{_SELLS}, p AS (SELECT src AS a, src AS z, 0 AS hops FROM f WHERE src = 3 UNION SELECT a, dst, hops + 1 FROM p JOIN f ON src = z WHERE hops < 8), s AS (SELECT z, min(hops) AS hops FROM p GROUP BY 1) SELECT n_name AS name, hops, hops + 1 AS places FROM s JOIN nation ON n_nationkey = z WHERE hops > 0")
def cypher_shortest_path(spark, d):
    return cypher(_trade(spark, d), "MATCH (a:Nation {key: 3}), (b:Nation) WHERE a <> b MATCH p = shortestPath((a)-[:SELLS_TO*]->(b)) RETURN b.n_name AS name, length(p) AS hops, size(nodes(p)) AS places")


@query(f"{_SELLS}, p AS (SELECT src AS a, src AS z, 0 AS hops FROM f WHERE src = 3 UNION SELECT a, dst, hops + 1 FROM p JOIN f ON src = z WHERE hops < 8) SELECT n_name AS name, min(hops) AS hops FROM p JOIN nation ON n_nationkey = z WHERE hops > 0 AND z <> 3 GROUP BY 1")
def cypher_shortest_path_unbound(spark, d):
    """The ends are what is reached."""
    return cypher(_trade(spark, d), "MATCH p = shortestPath((a:Nation {key: 3})-[:SELLS_TO*]->(b)) RETURN b.n_name AS name, length(p) AS hops")
