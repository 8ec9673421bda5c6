"""Procedures that CALL reaches from Cypher: graph algorithms, expansion of paths, metadata.

A procedure sees the relationships of some types (all, if none are named) as one
edge table. Where they join nodes of several labels, a node's number is its id
times the number of labels, and the place of its label; the columns that hold
nodes are turned back into id and label before the query goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import algorithms as G
from ..operators import centrality as C
from ..operators import sequential as Q
from ..operators import structure as S
from ..operators.pattern import Graph
from ..operators.pattern import traverse as walk


class Projection:
    """The edges and nodes that a procedure works on, and its arguments: nodes as (label, id), other values as they are."""

    def __init__(self, graph: Graph, spark, args: list[Any]):
        self.graph, self.spark, self.args = graph, spark, args
        self.config: dict[str, Any] = next((a for a in args if isinstance(a, dict)), {})
        self.plain = [a for a in args if not isinstance(a, dict | tuple)]
        self.ends = [a for a in args if isinstance(a, tuple)]
        types = self.config.get("relTypes") or self.config.get("relationshipTypes") or next((a for a in self.plain if self._types(a)), None)
        self.types = self._types(types) or list(graph.edges)
        labels = [x for t in self.types for x in graph.ends[t]] + [label for label, _ in self.ends]
        self.labels = sorted(set(labels))
        self.plain = [a for a in self.plain if not self._types(a)]

    def _types(self, a: Any) -> list[str]:
        parts = [x.strip() for x in a.split(",")] if isinstance(a, str) else list(a) if isinstance(a, list) else []
        return parts if parts and all(x in self.graph.edges for x in parts) else []

    def _code(self, c: Column, label: str) -> Column:
        return c.cast("long") * len(self.labels) + self.labels.index(label)

    def node(self, n: int) -> int:
        label, own = self.ends[n]
        return int(own) * len(self.labels) + self.labels.index(label)

    @property
    def edges(self) -> DataFrame:
        """src, dst, and weight where a weight property is named."""
        out: DataFrame | None = None
        weight = self.config.get("weightProperty") or self.config.get("weight") or next((a for a in self.plain if isinstance(a, str) and any(a in self.graph.edges[t][0].columns for t in self.types)), None)
        way = str(self.config.get("direction") or next((a for a in self.plain if isinstance(a, str) and a.upper() in ("IN", "OUT", "BOTH")), "OUT")).upper()
        for t in self.types:
            df, src, dst = self.graph.edges[t]
            a, b = self.graph.ends[t]
            held = [F.col(weight).cast("double").alias("weight")] if weight and weight in df.columns else [F.lit(1.0).alias("weight")] if weight else []
            one = df.select(self._code(F.col(src), a).alias("src"), self._code(F.col(dst), b).alias("dst"), *held)
            out = one if out is None else out.unionByName(one)
        assert out is not None
        if way == "IN":
            out = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *out.columns[2:])
        elif way == "BOTH":
            out = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *out.columns[2:]))
        return out

    def weighted(self) -> DataFrame:
        e = self.edges
        return e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0))

    def option(self, key: str, default: Any, kind: type = int) -> Any:
        """A setting of the configuration map, or the first plain argument of its kind."""
        v = self.config.get(key)
        if v is None:
            v = next((a for a in self.plain if isinstance(a, kind) and not isinstance(a, bool)), default)
        return v

    def grouped(self) -> DataFrame:
        """node, community from a property of the nodes."""
        key = next(a for a in [*self.plain, *self.config.values()] if isinstance(a, str))
        out: DataFrame | None = None
        for label in self.labels:
            df, own = self.graph.vertices[label]
            if key in df.columns:
                one = df.select(self._code(F.col(own), label).alias("node"), F.col(key).alias("community"))
                out = one if out is None else out.unionByName(one)
        assert out is not None
        return out

    def label_of(self, c: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.labels)), (F.pmod(c, F.lit(len(self.labels))) + 1).cast("int"))

    def id_of(self, c: Column) -> Column:
        return F.floor(c / len(self.labels)).cast("long") if len(self.labels) > 1 else c


#: name in lower case: (rows, columns that hold nodes)
PROCEDURES: dict[str, tuple[Callable[[Projection], DataFrame], tuple[str, ...]]] = {}


def procedure(*names: str, nodes: tuple[str, ...] = ("node",)):
    def add(f):
        for n in names:
            PROCEDURES[n.lower()] = (f, nodes)
        return f

    return add


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _scores(name: str, f: Callable[[Projection], DataFrame], node: str = "node", **columns: str) -> None:
    PROCEDURES[name.lower()] = ((lambda p: _named(f(p), **{node: "node"}, **columns)), (node,))


def _damped(of):
    return lambda p: of(p.edges, rounds=int(p.config.get("maxIterations", 20)), damping=float(p.config.get("dampingFactor", 0.85)), tolerance=float(p.config.get("tolerance", 0.0001)))


_scores("algo.pagerank", _damped(G.page_rank), score="score")
_scores("algo.articleRank", _damped(C.article_rank), score="score")
_scores("algo.personalizedPageRank", lambda p: C.personalized_page_rank(p.edges, p.node(0), int(p.config.get("maxIterations", 20)), float(p.config.get("dampingFactor", 0.85))), node="nodeId", score="score")
_scores("algo.katz", lambda p: C.katz(p.edges, float(p.option("alpha", 0.005, float)), int(p.config.get("maxIterations", 100))), node="nodeId", score="score")
_scores("algo.eigenvector", lambda p: C.eigenvector(p.edges, int(p.config.get("maxIterations", 20))), score="score")
_scores("algo.hits", lambda p: C.hits(p.edges, int(p.config.get("maxIterations", 20))), hubScore="hub", authorityScore="authority")
_scores("algo.degree", lambda p: G.degree(p.edges), inDegree="in_degree", outDegree="out_degree", degree="degree", score="degree")
_scores("algo.wcc", lambda p: G.connected_components(p.edges), componentId="component")
_scores("algo.scc", lambda p: S.strong_components(p.edges), componentId="component")
_scores("algo.labelPropagation", lambda p: G.label_propagation(p.edges, int(p.option("maxIterations", 10))), communityId="community")
_scores("algo.kcore", lambda p: G.k_core(p.edges), coreNumber="core")
_scores("algo.triangleCount", lambda p: G.triangles(p.edges), triangles="triangles", clusteringCoefficient="coefficient")
_scores("algo.localClusteringCoefficient", lambda p: G.triangles(p.edges), localClusteringCoefficient="coefficient")
_scores("algo.betweenness", lambda p: S.betweenness(p.edges), score="score")
_scores("algo.closeness", lambda p: C.distance_centralities(p.edges), score="closeness")
_scores("algo.harmonic", lambda p: C.distance_centralities(p.edges), score="harmonic")
_scores("algo.graphColoring", lambda p: S.colouring(p.edges), color="colour")
_scores("algo.topologicalSort", lambda p: S.topological_levels(p.edges), order="level")
_scores("algo.longestPath", lambda p: S.longest_paths(p.edges), distance="length")
_scores("algo.louvain", lambda p: Q.louvain(p.edges, int(p.config.get("maxIterations", 10)), float(p.config.get("tolerance", 0.0001))), communityId="community")
_scores("algo.articulationPoints", lambda p: Q.articulation_points(p.edges))
_scores("algo.biconnectedComponents", lambda p: Q.biconnected_components(p.edges), componentId="component")
_scores("algo.voteRank", lambda p: Q.vote_rank(p.edges, p.option("topK", None)), node="nodeId", rank="rank")
_scores("algo.dfs", lambda p: Q.depth_first(p.edges, p.node(0)), depth="depth")
_scores("algo.densestSubgraph", lambda p: Q.densest_subgraph(p.edges), density="density")
_scores("algo.bfs", lambda p: walk(p.edges, p.spark.createDataFrame([(p.node(0),)], "id long"), int(p.option("maxDepth", 1_000_000))).withColumnRenamed("id", "node").filter("depth > 0"), depth="depth")
_scores("algo.dijkstra.singleSource", lambda p: G.shortest_distances(p.weighted(), p.node(0)), cost="cost")


@procedure("algo.eccentricity")
def eccentricity(p):
    out = C.distance_centralities(p.edges).select("node", "eccentricity")
    ends = F.broadcast(out.agg(F.min("eccentricity").alias("least"), F.max("eccentricity").alias("most")))  # one row
    return out.crossJoin(ends).select("node", "eccentricity", (F.col("eccentricity") == F.col("least")).alias("isCenter"), (F.col("eccentricity") == F.col("most")).alias("isPeripheral"))


@procedure("algo.apsp", nodes=("source", "target"))
def all_pairs(p):
    return C.distances(p.edges).select("source", F.col("node").alias("target"), F.col("hops").cast("double").alias("distance"))


@procedure("algo.bellmanFord", "algo.dijkstra", nodes=())
def one_path(p):
    """The cost of the cheapest path between two nodes; negative weights are allowed, a negative cycle is told."""
    try:
        cost = S.bellman_ford(p.weighted(), p.node(0)).filter(F.col("node") == p.node(1))
    except ValueError:
        return p.spark.createDataFrame([(None, True)], "weight double, negativeCycle boolean")
    return cost.select(F.col("cost").alias("weight"), F.lit(False).alias("negativeCycle"))


@procedure("algo.bridges", nodes=("source", "target"))
def bridges(p):
    return _named(S.bridges(p.edges), source="src", target="dst")


@procedure("algo.bipartite")
def bipartite(p):
    out = S.bipartite(p.edges)
    odd = F.broadcast(out.agg((F.count_if(F.col("side").isNull()) == 0).alias("isBipartite")))  # one row
    return out.crossJoin(odd).select("node", F.col("side").alias("partition"), "isBipartite")


@procedure("algo.bipartiteMatching", nodes=("node1", "node2"))
def matching(p):
    out = Q.bipartite_matching(p.edges)
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("matchingSize"))))  # one row


@procedure("algo.cycleDetection")
def cycles(p):
    on = S.cycle_nodes(p.edges).withColumn("inCycle", F.lit(True))
    some = F.broadcast(on.agg((F.count("*") > 0).alias("hasCycle")))  # one row
    return G.nodes(p.edges).join(on, "node", "left").crossJoin(some).select("node", F.coalesce("inCycle", F.lit(False)).alias("inCycle"), "hasCycle")


@procedure("algo.mst", nodes=("source", "target"))
def spanning(p):
    out = S.spanning_forest(p.weighted())
    return out.crossJoin(F.broadcast(out.agg(F.sum("weight").alias("totalWeight")))).select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "totalWeight")  # one row


@procedure("algo.kTruss", nodes=("node1", "node2"))
def truss(p):
    """The relationships of the k-truss."""
    return _named(S.k_truss(p.edges, int(p.option("k", 3))), node1="src", node2="dst")


@procedure("algo.knn", nodes=("node1", "node2"))
def knn(p):
    return _named(S.neighbour_knn(p.edges, int(p.option("k", 10))), node1="node", node2="other", similarity="similarity")


@procedure("algo.clique", nodes=())
def cliques(p):
    out = Q.maximal_cliques(p.edges).filter(F.col("size") >= int(p.option("minSize", 1)))
    return out.select(F.transform("clique", lambda c: p.id_of(c)).alias("clique"), "size")


@procedure("algo.maxFlow", nodes=("sourceId", "sinkId"))
def flow(p):
    return Q.max_flow(p.weighted(), p.node(0), p.node(1)).select(F.col("flow").alias("maxFlow"), F.lit(p.node(0)).cast("long").alias("sourceId"), F.lit(p.node(1)).cast("long").alias("sinkId"))


def _linked(name: str, column: str, shown: str) -> None:
    def f(p):
        out = C.total_neighbours(p.edges, p.node(0)) if column == "total" else G.neighbour_scores(p.edges, p.node(0))
        return out.select(F.lit(p.node(0)).cast("long").alias("node1"), F.col("node").alias("node2"), F.col("score" if column == "total" else column).alias(shown))

    PROCEDURES[name.lower()] = (f, ("node1", "node2"))


for _name, _column, _shown in (
    ("algo.jaccard", "jaccard", "similarity"), ("algo.adamicAdar", "adamic_adar", "score"), ("algo.commonNeighbors", "common", "commonNeighbors"), ("algo.preferentialAttachment", "preferential", "score"), ("algo.resourceAllocation", "resource", "score"),
    ("algo.totalNeighbors", "total", "coefficient"),
):
    _linked(_name, _column, _shown)


@procedure("algo.assortativity", nodes=())
def assortativity(p):
    return C.assortativity(p.edges).withColumn("edgeCount", F.lit(p.edges.count()))


@procedure("algo.graphSummary", nodes=())
def summary(p):
    return _named(C.graph_summary(p.edges), nodeCount="nodes", edgeCount="edges", avgDegree="mean_degree", density="density", selfLoops="loops")


@procedure("algo.richClub", nodes=())
def rich_club(p):
    return _named(C.rich_club(p.edges), degree="degree", richClubCoefficient="coefficient", nodeCount="nodes")


@procedure("algo.modularityScore", nodes=())
def modularity(p):
    groups = p.grouped()
    return C.modularity(p.edges, groups).crossJoin(F.broadcast(groups.agg(F.count_distinct("community").alias("communities")))).withColumn("edgeCount", F.lit(p.edges.count()))  # one row


@procedure("algo.conductance", nodes=())
def conductance(p):
    return C.conductance(p.edges, p.grouped())


@procedure("algo.sameCommunity", nodes=("node1", "node2"))
def same_community(p):
    a, b = p.node(0), p.node(1)
    held = p.grouped().filter(F.col("node").isin(a, b)).agg(F.coalesce((F.count("community") == 2) & (F.count_distinct("community") == 1), F.lit(False)).cast("double").alias("coefficient"))
    return held.select(F.lit(a).cast("long").alias("node1"), F.lit(b).cast("long").alias("node2"), "coefficient")


@procedure("algo.randomWalk", nodes=())
def random_walk(p):
    steps = int(p.option("steps", 10))
    out = S.random_walks(p.edges, p.spark.createDataFrame([(p.node(0),)], "node long"), steps, int(p.config.get("seed", 0)))
    return out.select(F.transform("nodes", lambda c: p.id_of(c)).alias("path"), (F.size("nodes") - 1).alias("steps"))


@procedure("algo.allSimplePaths", nodes=())
def simple_paths(p):
    out = S.simple_paths(p.edges, p.node(0), p.node(1), int(p.option("maxDepth", 4)))
    return out.select(F.transform("nodes", lambda c: p.id_of(c)).alias("path"))


@procedure("path.subgraphNodes")
def subgraph_nodes(p):
    start = p.spark.createDataFrame([(p.node(0),)], "id long")
    return _named(walk(p.edges, start, int(p.config.get("maxLevel", 1_000_000)), True), node="id")


@procedure("path.spanningTree", nodes=("node", "parent"))
def spanning_tree(p):
    """Each node that is reached, with the least neighbour one level nearer to the start; null for the start."""
    start = p.spark.createDataFrame([(p.node(0),)], "id long")
    seen = walk(p.edges, start, int(p.config.get("maxLevel", 1_000_000)), True)
    both = G.undirected(p.edges)
    near = seen.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth"))
    up = both.join(near, "dst").join(seen.select(F.col("id").alias("src"), "depth"), ["src", "depth"]).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    return seen.join(up, "id", "left").select(F.col("id").alias("node"), "parent", "depth")


# metadata


def _catalog(p: Projection, rows: list[tuple], schema: str) -> DataFrame:
    return p.spark.createDataFrame(rows, schema)


@procedure("db.labels", nodes=())
def labels(p):
    return _catalog(p, [(x,) for x in sorted(p.graph.vertices)], "label string")


@procedure("db.relationshipTypes", nodes=())
def relationship_types(p):
    return _catalog(p, [(x,) for x in sorted(p.graph.edges)], "relationshipType string")


@procedure("db.propertyKeys", nodes=())
def property_keys(p):
    held = {c for t in (*p.graph.vertices.values(), *p.graph.edges.values()) for c in t[0].columns}
    return _catalog(p, [(x,) for x in sorted(held)], "propertyKey string")


@procedure("db.schema.visualization", nodes=())
def schema(p):
    rows = [(n, "vertex", sorted(t[0].columns)) for n, t in sorted(p.graph.vertices.items())] + [(n, "edge", sorted(t[0].columns)) for n, t in sorted(p.graph.edges.items())]
    return _catalog(p, rows, "name string, type string, properties array<string>")


def _property_types(kind: str):
    def f(p):
        held = p.graph.vertices if kind == "nodeType" else p.graph.edges
        rows = [(n, x.name, [x.dataType.simpleString()], not x.nullable) for n, t in sorted(held.items()) for x in t[0].schema.fields]
        return _catalog(p, rows, f"{kind} string, propertyName string, propertyTypes array<string>, mandatory boolean")

    return f


PROCEDURES["meta.nodetypeproperties"] = (_property_types("nodeType"), ())
PROCEDURES["meta.reltypeproperties"] = (_property_types("relType"), ())


@procedure("meta.graph", nodes=())
def meta_graph(p):
    return _catalog(p, [(sorted(p.graph.vertices), [{"type": t, "from": a, "to": b} for t, (a, b) in sorted(p.graph.ends.items())])], "nodes array<string>, relationships array<struct<type: string, `from`: string, `to`: string>>")


@procedure("meta.stats", nodes=())
def stats(p):
    """Counts of all nodes and relationships, and by label and type."""
    count = lambda held: {n: t[0].count() for n, t in sorted(held.items())}
    n, e = count(p.graph.vertices), count(p.graph.edges)
    return _catalog(p, [(sum(n.values()), sum(e.values()), n, e)], "nodeCount long, relCount long, labels map<string,long>, relTypes map<string,long>")
