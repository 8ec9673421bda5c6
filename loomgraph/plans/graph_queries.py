"""Registered queries over node scores and graph structure, each with the SQL that says the same where there is some."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algorithms as G
from ..operators import centrality as C
from ..operators import structure as S
from ..sources.tables import table
from .queries import _BOTH, _BOUGHT, _MARKET, _MB, _SUPPLY, _TB, _TRI, bought, market, query, supply, trade

_V = "v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_ROUNDS = 4


def _walk_sql(share: str, home: str) -> str:
    steps = [f"e AS MATERIALIZED ({_MARKET})", _V, "k AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) * 1.0 / (SELECT count(*) FROM v) AS mean)", "o AS (SELECT src, count(*) AS n_out FROM e GROUP BY 1)",
             f"r0 AS (SELECT node, n_out, {home} AS score FROM v LEFT JOIN o ON o.src = v.node, k)"]
    for i in range(_ROUNDS):
        steps.append(f"g{i} AS (SELECT dst, sum({share}) AS got FROM e JOIN r{i} ON r{i}.node = e.src, k GROUP BY 1)")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node, n_out, 0.15 * {home} + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM r{i} WHERE n_out IS NULL) * {home}) AS score FROM r{i} LEFT JOIN g{i} ON g{i}.dst = node, k)")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM r{_ROUNDS}"


@query(_walk_sql("score / (n_out + mean)", "(1.0::DOUBLE / n)"))
def algo_article_rank(spark, d):
    return C.article_rank(market(spark, d), _ROUNDS, tolerance=0.0).withColumn("score", F.round("score", 9))


@query(_walk_sql("score / n_out", "(CASE WHEN node = 3 THEN 1.0::DOUBLE ELSE 0.0 END)"))
def algo_personalized_page_rank(spark, d):
    return C.personalized_page_rank(market(spark, d), 3, _ROUNDS, tolerance=0.0).withColumn("score", F.round("score", 9))


def _katz_sql() -> str:
    steps = [f"e AS ({_TRI})", _V, "s0 AS (SELECT node, 1.0::DOUBLE AS score FROM v)"]
    for i in range(_ROUNDS):
        steps.append(f"s{i + 1} AS (SELECT v.node, 1 + 0.005 * coalesce(sum(s{i}.score), 0) AS score FROM v LEFT JOIN e ON e.dst = v.node LEFT JOIN s{i} ON s{i}.node = e.src GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM s{_ROUNDS}"


@query(_katz_sql())
def algo_katz(spark, d):
    return C.katz(trade(spark, d), rounds=_ROUNDS, tolerance=0.0).withColumn("score", F.round("score", 9))


def _eigen_sql() -> str:
    steps = [_MB, "s0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS score FROM b)"]
    for i in range(_ROUNDS):
        steps.append(f"g{i} AS MATERIALIZED (SELECT b.dst AS node, sum(score) AS got FROM b JOIN s{i} ON s{i}.node = b.src GROUP BY 1)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT node, got / (SELECT sqrt(sum(got * got)) FROM g{i}) AS score FROM g{i})")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM s{_ROUNDS}"


@query(_eigen_sql())
def algo_eigenvector(spark, d):
    return C.eigenvector(market(spark, d), _ROUNDS, tolerance=0.0).withColumn("score", F.round("score", 9))


def _hits_sql() -> str:
    steps = [f"e AS MATERIALIZED ({_MARKET})", _V, "s0 AS (SELECT node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM v)"]
    for i in range(_ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED (SELECT dst AS node, sum(hub) AS a FROM e JOIN s{i} ON node = src GROUP BY 1)")
        steps.append(f"h{i} AS MATERIALIZED (SELECT src AS node, sum(authority) AS h FROM e JOIN s{i} ON node = dst GROUP BY 1)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT v.node, coalesce(h, 0) / (SELECT sqrt(sum(h * h)) FROM h{i}) AS hub, coalesce(a, 0) / (SELECT sqrt(sum(a * a)) FROM a{i}) AS authority FROM v LEFT JOIN a{i} ON a{i}.node = v.node LEFT JOIN h{i} ON h{i}.node = v.node)")
    return f"WITH {', '.join(steps)} SELECT node, round(hub, 9) AS hub, round(authority, 9) AS authority FROM s{_ROUNDS}"


@query(_hits_sql())
def algo_hits(spark, d):
    return C.hits(market(spark, d), _ROUNDS, tolerance=0.0).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


_HOPS = f"WITH RECURSIVE {_TB}, w AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM b UNION SELECT w.source, b.dst, w.hops + 1 FROM w JOIN b ON b.src = w.node WHERE w.hops < 8), s AS (SELECT source, node, min(hops) AS hops FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e))"


@query(f"{_HOPS} SELECT source AS node, round(count(*) * 1.0 / sum(hops) * count(*) / (any_value(n) - 1), 9) AS closeness, round(sum(1.0 / hops) / (any_value(n) - 1), 9) AS harmonic, max(hops) AS eccentricity FROM s, n WHERE hops > 0 GROUP BY 1")
def algo_distance_centralities(spark, d):
    """Closeness, harmonic centrality and eccentricity."""
    out = C.distance_centralities(trade(spark, d))
    return out.select("node", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 9).alias("harmonic"), "eccentricity")


@query(f"{_HOPS} SELECT source, node, hops FROM s")
def algo_all_pairs_distances(spark, d):
    return C.distances(trade(spark, d))


@query(f"WITH {_MB}, own AS (SELECT dst FROM b WHERE src = 3) SELECT src AS node, (SELECT count(*) FROM own) + count(*) - count(own.dst) AS score FROM b LEFT JOIN own ON own.dst = b.dst WHERE src <> 3 GROUP BY 1")
def algo_total_neighbours(spark, d):
    return C.total_neighbours(market(spark, d), 3)


@query(f"WITH e AS ({_BOUGHT}), v AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)), c AS (SELECT count(*) AS m, count(*) FILTER (src = dst) AS loops FROM e) SELECT n AS nodes, m AS edges, round(m * 1.0 / n, 9) AS mean_degree, round(2.0 * m / (n * (n - 1)), 9) AS density, loops FROM v, c")
def algo_graph_summary(spark, d):
    return C.graph_summary(bought(spark, d)).withColumn("mean_degree", F.round("mean_degree", 9)).withColumn("density", F.round("density", 9))


@query(f"WITH {_BOTH}, g AS (SELECT src, count(*) AS n FROM b GROUP BY 1) SELECT round(corr(x.n, y.n), 6) AS assortativity FROM b JOIN g x ON x.src = b.src JOIN g y ON y.src = b.dst")
def algo_assortativity(spark, d):
    return C.assortativity(bought(spark, d)).select(F.round("assortativity", 6).alias("assortativity"))


@query(f"""WITH {_BOTH}, g AS (SELECT src, count(*) AS n FROM b GROUP BY 1), k AS (SELECT DISTINCT n AS degree FROM g), v AS (SELECT degree, count(*) AS nodes FROM k JOIN g ON g.n > degree GROUP BY 1),
l AS (SELECT degree, count(*) AS edges FROM k JOIN (SELECT x.n AS a, y.n AS c FROM b JOIN g x ON x.src = b.src JOIN g y ON y.src = b.dst WHERE b.src < b.dst) ON a > degree AND c > degree GROUP BY 1)
SELECT v.degree, nodes, round(2.0 * coalesce(edges, 0) / (nodes * (nodes - 1)), 9) AS coefficient FROM v LEFT JOIN l ON l.degree = v.degree WHERE nodes > 1""")
def algo_rich_club(spark, d):
    return C.rich_club(bought(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


def _regions(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("community"))


_REGIONS = f"WITH {_TB}, j AS (SELECT x.n_regionkey AS a, y.n_regionkey AS c FROM b JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst), g AS (SELECT a, count(*) FILTER (a = c) AS inside, count(*) AS ends FROM j GROUP BY 1)"


@query(f"{_REGIONS} SELECT round(sum(inside * 1.0 / (SELECT sum(ends) FROM g) - pow(ends * 1.0 / (SELECT sum(ends) FROM g), 2)), 9) AS modularity FROM g")
def algo_modularity(spark, d):
    return C.modularity(trade(spark, d), _regions(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query(f"{_REGIONS} SELECT a AS community, round((ends - inside) * 1.0 / least(ends, (SELECT sum(ends) FROM g) - ends), 9) AS conductance FROM g")
def algo_conductance(spark, d):
    return C.conductance(trade(spark, d), _regions(spark, d)).withColumn("conductance", F.round("conductance", 9))


@query(f"WITH RECURSIVE e AS ({_TRI}), {_V}, r AS (SELECT node AS a, node AS z FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.z) SELECT x.a AS node, min(y.a) AS component FROM r x JOIN r y ON y.a = x.z AND y.z = x.a GROUP BY 1")
def algo_strong_components(spark, d):
    return S.strong_components(trade(spark, d))


@query(f"WITH RECURSIVE e AS ({_TRI}), r AS (SELECT src AS a, dst AS z FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.z) SELECT a AS node FROM r WHERE a = z")
def algo_cycle_detection(spark, d):
    return S.cycle_nodes(trade(spark, d))


@query(f"WITH RECURSIVE e AS ({_SUPPLY}), {_V}, p AS (SELECT node, 0 AS n FROM v UNION SELECT e.dst, n + 1 FROM p JOIN e ON e.src = p.node) SELECT node, max(n) AS level FROM p GROUP BY 1")
def algo_topological_sort(spark, d):
    return S.topological_levels(supply(spark, d))


@query(f"WITH RECURSIVE e AS ({_SUPPLY}), {_V}, p AS (SELECT node, 0 AS n FROM v UNION SELECT e.dst, n + 1 FROM p JOIN e ON e.src = p.node) SELECT node, max(n) AS length FROM p GROUP BY 1")
def algo_longest_path(spark, d):
    return S.longest_paths(supply(spark, d))


@query(f"WITH {_BOTH} SELECT count(DISTINCT src) AS nodes, 0 AS odd FROM b")
def algo_bipartite(spark, d):
    return S.bipartite(bought(spark, d)).agg(F.count("*").alias("nodes"), F.count_if(F.col("side").isNull()).alias("odd"))


@query()
def algo_spanning_forest(spark, d):
    return S.spanning_forest(bought(spark, d).withColumn("weight", ((F.col("src") * 7 + F.col("dst")) % 11).cast("double")))


@query()
def algo_k_truss(spark, d):
    return S.k_truss(trade(spark, d), 4)


@query()
def algo_colouring(spark, d):
    return S.colouring(trade(spark, d))


@query()
def algo_random_walk(spark, d):
    return S.random_walks(trade(spark, d), G.nodes(trade(spark, d)), 5)


@query(f"WITH RECURSIVE e AS (SELECT *, CAST((src + dst) % 7 - 3 AS DOUBLE) AS weight FROM ({_SUPPLY})), s AS (SELECT min(src) AS node, 0.0::DOUBLE AS cost FROM e UNION SELECT e.dst, cost + weight FROM s JOIN e ON e.src = s.node) SELECT node, min(cost) AS cost FROM s GROUP BY 1")
def algo_bellman_ford(spark, d):
    e = supply(spark, d).withColumn("weight", ((F.col("src") + F.col("dst")) % 7 - 3).cast("double"))
    return S.bellman_ford(e, e.agg(F.min("src")).first()[0])


@query()
def algo_betweenness(spark, d):
    return S.betweenness(trade(spark, d)).withColumn("score", F.round("score", 9))


@query()
def algo_bridges(spark, d):
    return S.bridges(bought(spark, d))


@query(f"WITH RECURSIVE e AS ({_TRI}), p AS (SELECT [3::BIGINT] AS v UNION ALL SELECT list_append(v, dst) FROM p JOIN e ON src = v[-1] WHERE v[-1] <> 7 AND len(v) < 4 AND NOT list_contains(v, dst)) SELECT array_to_string(v, ',') AS nodes, CAST(len(v) - 1 AS BIGINT) AS length FROM p WHERE v[-1] = 7")
def algo_all_simple_paths(spark, d):
    return S.simple_paths(trade(spark, d), 3, 7, 3).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(f"""WITH {_TB}, m AS (SELECT x.src AS node, y.src AS other, count(*) AS c FROM b x JOIN b y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2), s AS (SELECT m.node, other, c * 1.0 / (x.n + y.n - c) AS s FROM m JOIN deg x ON x.node = m.node JOIN deg y ON y.node = other),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, other) AS k FROM s) SELECT node, other, round(s, 9) AS similarity FROM r WHERE k <= 5""")
def algo_knn(spark, d):
    return S.neighbour_knn(trade(spark, d), 5).withColumn("similarity", F.round("similarity", 9))
