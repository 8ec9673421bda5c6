"""Registered queries that change a graph and read what came of it, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pattern import Graph
from .changes import cypher_change, sql_script
from .queries import ORACLES, QUERIES, graph


def _then(kind: str, name: str, text: str, read: Callable[[Graph], DataFrame] | None, oracle: str, **params) -> None:
    """read: what to show of the graph after the change; its own rows, if it isn't given."""

    def run(spark, d):
        new, out = (cypher_change if kind == "cypher" else sql_script)(graph(spark, d), text, **params)
        return read(new) if read else out

    QUERIES[f"{kind}_{name}"] = run
    ORACLES[f"{kind}_{name}"] = oracle


_customers = lambda g: g.vertices["Customer"][0]
_BALANCES = lambda g: _customers(g).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))

_then("cypher", "set", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE n.n_regionkey = 1 SET c.c_acctbal = c.c_acctbal + 100, c.c_name = n.n_name", _BALANCES,
      "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name, round(c_acctbal + CASE WHEN n_regionkey = 1 THEN 100 ELSE 0 END, 2) AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey")
_then("cypher", "remove", "MATCH (c:Customer) WHERE c.c_acctbal < 0 REMOVE c.c_name SET c += {c_acctbal: 0.0}", _BALANCES, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, round(greatest(c_acctbal, 0), 2) AS c_acctbal FROM customer")
_then("cypher", "detach_delete", "MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c", lambda g: g.edges["PLACED"][0].select("o_orderkey", "o_custkey").join(_customers(g).select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "full").select("o_orderkey", "c_custkey"),
      "SELECT o_orderkey, c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
_then("cypher", "delete_relationships", "MATCH (c:Customer)-[r:PLACED]->(o) WHERE r.o_orderstatus = 'F' DELETE r", lambda g: g.edges["PLACED"][0].select("o_orderkey", "o_orderstatus"),
      "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
_then("cypher", "create", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) CREATE (s)-[:STORES {since: s.s_suppkey % 7}]->(w:Warehouse {of: s.s_name, at: n.n_name})",
      lambda g: g.vertices["Warehouse"][0].join(g.edges["STORES"][0], F.col("id") == F.col("dst")).select(F.col("src").alias("s"), "of", "at", "since"), "SELECT s_suppkey AS s, s_name AS of, n_name AS at, s_suppkey % 7 AS since FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_then("cypher", "merge", "MATCH (p:Part) MERGE (b:Brand {name: p.p_brand}) ON CREATE SET b.seen = 1 MERGE (p)-[:OF]->(b) ON CREATE SET p.p_size = 0", lambda g: g.edges["OF"][0].join(g.vertices["Brand"][0], F.col("dst") == F.col("id")).groupBy("name", "seen").agg(F.count("*").alias("n")),
      "SELECT p_brand AS name, 1 AS seen, count(*) AS n FROM part GROUP BY 1")
_then("cypher", "merge_match", "MATCH (n:Nation) WITH n.n_regionkey AS k, count(*) AS c MERGE (r:Region {r_regionkey: k}) ON MATCH SET r.r_name = r.r_name + toString(c) ON CREATE SET r.r_name = 'new'", lambda g: g.vertices["Region"][0].select("r_regionkey", "r_name"),
      "SELECT r_regionkey, r_name || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS r_name FROM region")
_then("cypher", "foreach", "MATCH (n:Nation) FOREACH (k IN range(1, n.n_regionkey + 1) | CREATE (:Mark {of: n.n_name, k: k}))", lambda g: g.vertices["Mark"][0].select("of", "k"), "SELECT n_name AS of, unnest(range(1, n_regionkey + 2)) AS k FROM nation")
_then("sql", "insert", "INSERT INTO Region (r_regionkey, r_name) VALUES (70, 'NORTH'), (71, 'SOUTH'); INSERT INTO Region FROM (SELECT n_nationkey + 100 AS r_regionkey, n_name AS r_name FROM Nation); INSERT INTO Region SET r_regionkey = 72, r_name = 'EAST'", lambda g: g.vertices["Region"][0].select("r_regionkey", "r_name"),
      "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (70, 'NORTH'), (71, 'SOUTH'), (72, 'EAST') UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
_then("sql", "update", "UPDATE Customer SET c_acctbal += 10, c_mktsegment = c_mktsegment.toLowerCase() WHERE c_acctbal > 5000; UPDATE Customer REMOVE c_name WHERE c_custkey < 5; UPDATE Customer MERGE {vip: true} WHERE c_acctbal > 9000", lambda g: _customers(g).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment", F.coalesce("vip", F.lit(False)).alias("vip")),
      "SELECT c_custkey, CASE WHEN c_custkey < 5 THEN NULL ELSE c_name END AS c_name, round(b, 2) AS c_acctbal, CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, b > 9000 AS vip FROM (SELECT *, c_acctbal + CASE WHEN c_acctbal > 5000 THEN 10 ELSE 0 END AS b FROM customer)")
_then("sql", "upsert", "UPDATE Region SET r_name = 'FIRST' UPSERT WHERE r_regionkey = 0; UPDATE Region SET r_name = 'NEW' UPSERT WHERE r_regionkey = 99", lambda g: g.vertices["Region"][0].select("r_regionkey", "r_name"),
      "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'FIRST' ELSE r_name END AS r_name FROM region UNION ALL SELECT 99, 'NEW'")
_then("sql", "delete", "DELETE VERTEX Part WHERE p_size > 20; DELETE EDGE PLACED WHERE o_totalprice < 1000", lambda g: g.edges["CONTAINS"][0].groupBy("l_partkey").agg(F.count("*").alias("n")), "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY 1")
_then("sql", "create_edge", "CREATE EDGE TYPE NEAR FROM Nation TO Region; CREATE EDGE NEAR FROM (SELECT FROM Nation WHERE n_regionkey = 2) TO (SELECT FROM Region WHERE r_regionkey < 2) SET w = 5; CREATE EDGE NEAR FROM (SELECT FROM Nation) TO (SELECT FROM Region WHERE r_regionkey = 0) IF NOT EXISTS",
      lambda g: g.edges["NEAR"][0].select("src", "dst", F.coalesce("w", F.lit(0)).alias("w")), "SELECT n_nationkey AS src, r_regionkey AS dst, CASE WHEN n_regionkey = 2 THEN 5 ELSE 0 END AS w FROM nation, region WHERE r_regionkey = 0 OR (r_regionkey < 2 AND n_regionkey = 2)")
_then("sql", "schema", "CREATE VERTEX TYPE City; CREATE PROPERTY City.name STRING; CREATE PROPERTY City.size LONG; INSERT INTO City FROM (SELECT n_name AS name, n_regionkey AS size FROM Nation); ALTER PROPERTY City.size NAME area; MOVE VERTEX (SELECT FROM City WHERE area = 1) TO TYPE:City; TRUNCATE TYPE PLACED; DROP TYPE Supplier", lambda g: g.vertices["City"][0].select("name", "area"),
      "SELECT n_name AS name, n_regionkey AS area FROM nation")
_then("sql", "views_and_scripts", "CREATE MATERIALIZED VIEW big AS SELECT c_nationkey AS k, count(*) AS n FROM Customer WHERE c_acctbal > :least GROUP BY c_nationkey; BEGIN; DELETE FROM Customer; ROLLBACK; UPDATE Customer SET c_acctbal = 0 WHERE c_custkey < 50; REFRESH MATERIALIZED VIEW big; IF (1 > 2) { DELETE FROM Customer; } RETURN SELECT k, n FROM big", None,
      "SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_custkey >= 50 GROUP BY 1", least=1000)
