"""Graph algorithms over edge tables (src, dst: long). Each round is a join and a grouping, written to cut its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .triangles import counted


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree: one grouping of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    out = ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), by large and small stars in turn."""
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes(edges).join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles, coefficient. Edges lead from the end of fewer neighbours to the other, so that a hub's neighbours are never paired with each other."""
    deg, count = counted(edges)
    out = deg.join(count.withColumnRenamed("n", "triangles"), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.select("node", "triangles", F.when(F.col("n") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("n") * (F.col("n") - 1))).alias("coefficient"))


def settled(scores: DataFrame, tolerance: float, *columns: str) -> bool:
    """Whether no node's score differs by the tolerance from its `old_` one."""
    if tolerance <= 0:
        return False
    moved = scores.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in columns], F.lit(0.0)))).first()[0]
    return moved is None or moved < tolerance


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 0.0001) -> DataFrame:
    """node, score after so many rounds, or when no score moves by the tolerance, from 1 / n; what nodes without edges out hold is dealt to all."""
    step = written(edges.select("src", "dst"))
    n_out = step.groupBy("src").agg(F.count("*").alias("n_out"))
    rank = written(nodes(step).join(n_out.withColumnRenamed("src", "node"), "node", "left"))
    n = max(rank.count(), 1)
    rank = rank.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = rank.filter("n_out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        sent = step.join(rank.select(F.col("node").alias("src"), (F.col("score") / F.col("n_out")).alias("part")), "src").groupBy("dst").agg(F.sum("part").alias("got"))
        base = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        rank = written(rank.join(sent.withColumnRenamed("dst", "node"), "node", "left").crossJoin(F.broadcast(loose)).select("node", "n_out", F.col("score").alias("old_score"), base.alias("score")))  # loose is one row
        if settled(rank, tolerance, "score"):
            break
    return rank.select("node", "score")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community: each round every node takes its neighbours' most frequent label, the least of those that tie, until no label changes or the rounds are over. Nodes of loops alone keep their own."""
    both = written(undirected(edges))
    label = written(nodes(edges).withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("n"), "community")).alias("best"))
        new = written(label.withColumnRenamed("community", "old").join(best, "node", "left").select("node", "old", F.coalesce("best.community", "old").alias("community")))
        label = new.select("node", "community")
        if new.filter("old <> community").isEmpty():
            break
    return label


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: the h-index of the neighbours' estimates, from the degree on, until nothing changes; 0 for nodes of loops alone."""
    both = written(undirected(edges))
    core = written(both.groupBy("src").agg(F.count("*").cast("int").alias("core")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(core.withColumnRenamed("node", "dst"), "dst").groupBy("src", "core").agg(F.count("*").alias("n"))
        # h-index from counts of each value: the most of least(value, neighbours of that value or more)
        held = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("core", "n")), False).alias("by"))
        seen = F.aggregate("by", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h")), lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.greatest(s["h"], F.least(x["core"].cast("long"), s["n"] + x["n"])).alias("h")))
        new = written(held.select(F.col("src").alias("node"), seen["h"].cast("int").alias("core")))
        changed = new.alias("a").join(core.alias("b"), "node").filter("a.core <> b.core").limit(1).count()
        core = new
        if not changed:
            return nodes(edges).join(core, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))


def shortest_distances(edges: DataFrame, source: int) -> DataFrame:
    """node, cost from source along edges (src, dst, weight): relaxation of what changed, a round a join, until nothing does. ValueError for a weight below 0, for which see bellman_ford()."""
    step = written(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    if not step.filter("weight < 0").isEmpty():
        raise ValueError("a negative weight")
    best = written(edges.sparkSession.createDataFrame([(source, 0.0)], "node long, cost double"))
    front = best
    while True:
        new = front.join(step.withColumnRenamed("src", "node"), "node").groupBy("dst").agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        both = best.join(new.withColumnRenamed("dst", "node"), "node", "full")
        better = F.col("cost").isNull() | (F.col("new") < F.col("cost"))
        merged = written(both.select("node", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"), F.coalesce(better & F.col("new").isNotNull(), F.lit(False)).alias("moved")))
        best, front = merged.select("node", "cost"), merged.filter("moved").select("node", "cost")
        if not front.limit(1).count():
            break
    return best


def neighbour_scores(edges: DataFrame, source: int) -> DataFrame:
    """node, common, jaccard, adamic_adar, resource, preferential: link scores of source and every node two hops away."""
    both = written(undirected(edges))
    deg = both.groupBy("src").agg(F.count("*").alias("n"))
    own = both.filter(F.col("src") == source).select(F.col("dst").alias("via"))
    n_own = own.agg(F.count("*").alias("n_own"))
    met = own.join(deg.withColumnRenamed("src", "via").withColumnRenamed("n", "n_via"), "via").join(both.select(F.col("src").alias("via"), F.col("dst").alias("node")), "via").filter(F.col("node") != source)
    scored = met.groupBy("node").agg(F.count("*").alias("common"), F.sum(F.when(F.col("n_via") > 1, 1.0 / F.log("n_via")).otherwise(0.0)).alias("adamic_adar"), F.sum(1.0 / F.col("n_via")).alias("resource"))
    out = scored.join(deg.withColumnRenamed("src", "node"), "node").crossJoin(F.broadcast(n_own))  # one row
    return out.select("node", "common", (F.col("common") / (F.col("n") + F.col("n_own") - F.col("common"))).alias("jaccard"), "adamic_adar", "resource", (F.col("n") * F.col("n_own")).alias("preferential"))
