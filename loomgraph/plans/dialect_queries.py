"""Registered queries written in the SQL dialect, each with the plain SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pattern import Graph
from ..sources.tables import table
from .cypher_queries import _SELLS, _trade
from .dialect import sql
from .queries import graph, query
from .select import select


def _text(name: str, text: str, plain: str, **params) -> None:
    def run(spark, d):
        return sql(graph(spark, d), text, **params)

    run.__name__ = f"sql_{name}"
    run.__doc__ = text
    query(plain)(run)


_text("select", "SELECT c_custkey, c_name.toUpperCase().left(10) AS name, c_acctbal * 2 AS twice FROM Customer WHERE c_acctbal BETWEEN 0 AND :most AND NOT (c_mktsegment LIKE 'B%' OR c_nationkey IN [1, 2])", "SELECT c_custkey, left(upper(c_name), 10) AS name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND NOT (c_mktsegment LIKE 'B%' OR c_nationkey IN (1, 2))", most=5000)
_text("group_by", "SELECT c_mktsegment AS seg, count(*) AS n, sum(c_acctbal) > 0 AS rich, max(c_acctbal) AS top, median(c_acctbal) AS mid FROM Customer GROUP BY c_mktsegment ORDER BY n DESC", "SELECT c_mktsegment AS seg, count(*) AS n, sum(c_acctbal) > 0 AS rich, max(c_acctbal) AS top, median(c_acctbal) AS mid FROM customer GROUP BY 1")
_text("let", "SELECT o_orderkey, $half AS half, $half.asInteger() AS whole FROM `Order` LET $half = o_totalprice / 2 WHERE $half > 100000", "SELECT o_orderkey, o_totalprice / 2 AS half, CAST(trunc(o_totalprice / 2) AS INT) AS whole FROM orders WHERE o_totalprice / 2 > 100000")
_text("sub_select", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM Customer GROUP BY c_mktsegment) WHERE n > 10", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 10")
_text("out_size", "SELECT c_custkey, out('PLACED').size() AS n, out('LIVES_IN').n_name[0] AS nation FROM Customer WHERE out('PLACED').size() > 2", "SELECT c_custkey, n, n_name AS nation FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 2) ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
_text("expand", "SELECT expand(out('PLACED')) FROM Customer WHERE c_acctbal < 0", "SELECT orders.* FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0")
_text("unwind", "SELECT p_partkey, p_type.split(' ') AS word FROM Part WHERE p_size > 20 UNWIND word", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part WHERE p_size > 20")
_text("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM PLACED", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_text("top", "SELECT c_name, c_acctbal FROM Customer ORDER BY c_acctbal DESC, c_custkey SKIP 3 LIMIT 5", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 3")
_text("match", "MATCH {type: Customer, as: c, where: (c_acctbal > 9000)}.out('PLACED'){as: o, where: (o_orderstatus = 'F')}-CONTAINS->{as: p} RETURN c.c_name AS name, count(*) AS n, max(p.p_size) AS size GROUP BY c.c_name ORDER BY n", "SELECT c_name AS name, count(*) AS n, max(p_size) AS size FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 9000 AND o_orderstatus = 'F' GROUP BY 1")


@query(f"{_SELLS}, p AS (SELECT 3::BIGINT AS z, 0 AS n UNION SELECT dst, n + 1 FROM p JOIN f ON src = z WHERE n < 3), s AS (SELECT z, min(n) AS n FROM p GROUP BY 1) SELECT z AS key, n_name, n_regionkey, n AS \"$depth\" FROM s JOIN nation ON n_nationkey = z")
def sql_traverse(spark, d):
    return sql(_trade(spark, d), "TRAVERSE out('SELLS_TO') FROM Nation WHERE key = 3 MAXDEPTH 3")


@query("SELECT event_type, to_timestamp((epoch_us(ts) // 3600000000) * 3600)::TIMESTAMP AS hour, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def sql_time_bucket(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sql(Graph({"Event": (e, "event_id")}), "SELECT event_type, ts.timeBucket('1h', ts) AS hour, count(*) AS n, max(value) AS top FROM Event GROUP BY event_type, hour").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_text("match_optional", "MATCH {type: Customer, as: c, where: (c_acctbal > 5000)}.out('PLACED'){as: o, where: (o_orderstatus = 'F'), optional: true} RETURN c.c_custkey AS c, count(o.o_orderkey) AS n GROUP BY c.c_custkey", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE c_acctbal > 5000 GROUP BY 1")


@query("SELECT c_custkey, c_name FROM customer WHERE (c_acctbal > 5000 AND c_name LIKE 'C%') OR NOT (c_mktsegment IN ('BUILDING', 'MACHINERY')) AND (c_nationkey BETWEEN 3 AND 9 OR c_acctbal < 0)")
def select_where(spark, d):
    s = select(graph(spark, d)).from_type("Customer").where().property("c_acctbal").gt().parameter("least").and_().property("c_name").like().value("C%").or_().not_().property("c_mktsegment").in_().value(["BUILDING", "MACHINERY"]).and_()
    return s.block(lambda c: c.property("c_nationkey").between().value((3, 9)).or_().property("c_acctbal").lt().value(0)).compile().bind(least=5000).rows().select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 1000 AND o_custkey IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 3")
def select_ordered(spark, d):
    s = select(graph(spark, d)).from_type("Order").where().property("o_orderstatus").neq().value("F").and_().property("o_totalprice").ge().value(1000).and_().property("o_custkey").is_not_null()
    return s.order_by("o_totalprice", False).order_by("o_orderkey").skip(3).limit(10).rows().select("o_orderkey", "o_totalprice")


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal <= 0 GROUP BY 1")
def select_vertex_traversal(spark, d):
    return select(graph(spark, d)).from_type("Customer").where().property("c_acctbal").le().value(0).out("LIVES_IN").out("PART_OF").rows().groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def select_edge_traversal(spark, d):
    return select(graph(spark, d)).from_type("Part").where().property("p_size").eq().value(7).in_edges("CONTAINS").rows().select("l_orderkey", "l_linenumber")


@query("SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings WHERE label > 0 ORDER BY list_distance(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 3)), vec_id LIMIT 5")
def select_vector(spark, d):
    e = table(spark, d, "embeddings")
    target = [float(x) for x in e.filter("vec_id = 3").first()["embedding"]]
    return select(Graph({"V": (e, "vec_id")})).from_type("V").where().property("label").gt().value(0).nearest_to("embedding", target, 5).rows().select("vec_id", F.round("distance", 6).alias("distance"))
