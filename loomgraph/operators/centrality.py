"""Scores of nodes and of groupings of nodes, over edge tables (src, dst: long). Rounds are a join and a grouping each, written to cut the lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .algorithms import nodes, settled, undirected


def _one_row(rows: DataFrame, *aggs: Column) -> DataFrame:
    """Totals of a table, as a broadcast of one row."""
    return F.broadcast(rows.agg(*aggs))


def _received(step: DataFrame, scores: DataFrame, value: Column) -> DataFrame:
    """node, got: the sum over edges into node of value, an expression over the source's row of scores."""
    return step.join(scores.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(value).alias("got")).withColumnRenamed("dst", "node")


def _ranked(edges: DataFrame, rounds: int, damping: float, tolerance: float, share, start: int | None) -> DataFrame:
    """A walk with restarts, until no score moves by the tolerance: share gives what a node sends along each of its edges; restarts go to all nodes or to start."""
    step = written(edges.select("src", "dst"))
    degrees = step.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    rank = written(nodes(step).join(degrees, "node", "left"))
    n = rank.count()
    mean_out = step.count() / max(n, 1)
    home = F.lit(1.0 / max(n, 1)) if start is None else (F.col("node") == start).cast("double")
    rank = rank.withColumn("score", home)
    for _ in range(rounds):
        loose = _one_row(rank.filter("n_out is null"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        got = _received(step, rank, share(mean_out))
        new = (1 - damping) * home + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * home)
        rank = written(rank.join(got, "node", "left").crossJoin(loose).select("node", "n_out", F.col("score").alias("old_score"), new.alias("score")))  # one row
        if settled(rank, tolerance, "score"):
            break
    return rank.select("node", "score")


def article_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 0.0001) -> DataFrame:
    """node, score: as PageRank, but a node's share for an edge is divided by its edges out and the mean of all nodes, so that short lists count less."""
    return _ranked(edges, rounds, damping, tolerance, lambda mean: F.col("score") / (F.col("n_out") + mean), None)


def personalized_page_rank(edges: DataFrame, source: int, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, score: restarts, and what nodes without edges out hold, go to source."""
    return _ranked(edges, rounds, damping, tolerance, lambda mean: F.col("score") / F.col("n_out"), source)


def katz(edges: DataFrame, alpha: float = 0.005, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score: 1 and alpha times the scores of the nodes that lead here."""
    step = written(edges.select("src", "dst"))
    score = written(nodes(step).withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        new = written(score.join(_received(step, score, F.col("score")), "node", "left").select("node", F.col("score").alias("old"), (1 + alpha * F.coalesce("got", F.lit(0.0))).alias("score")))
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        score = new.select("node", "score")
        if moved is None or moved < tolerance:
            break
    return score


def eigenvector(edges: DataFrame, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """node, score by power iteration over edges in both directions, scaled to length 1 each round, until no score moves by the tolerance."""
    step = written(undirected(edges))
    score = written(nodes(step).withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        got = written(_received(step, score, F.col("score")))
        new = got.crossJoin(_one_row(got, F.sqrt(F.sum(F.col("got") * F.col("got"))).alias("length")))  # one row
        score = written(new.join(score.select("node", F.col("score").alias("old_score")), "node").select("node", "old_score", (F.col("got") / F.col("length")).alias("score")))
        if settled(score, tolerance, "score"):
            break
    return score.select("node", "score")


def _scaled(scores: DataFrame, columns: list[str]) -> DataFrame:
    lengths = _one_row(scores, *[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"{c}_length") for c in columns])
    return scores.crossJoin(lengths).select("node", *[F.when(F.col(f"{c}_length") > 0, F.col(c) / F.col(f"{c}_length")).otherwise(0.0).alias(c) for c in columns])  # one row


def hits(edges: DataFrame, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """node, hub, authority: both from the round before, scaled to length 1, until no score moves by the tolerance."""
    step = written(edges.select("src", "dst"))
    back = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    score = written(nodes(step).withColumn("hub", F.lit(1.0)).withColumn("authority", F.lit(1.0)))
    for _ in range(rounds):
        into = _received(step, score, F.col("hub")).withColumnRenamed("got", "a")
        out = _received(back, score, F.col("authority")).withColumnRenamed("got", "h")
        new = score.select("node").join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"))
        old = score.select("node", F.col("hub").alias("old_hub"), F.col("authority").alias("old_authority"))
        score = written(_scaled(written(new), ["hub", "authority"]).join(old, "node"))
        if settled(score, tolerance, "hub", "authority"):
            break
    return score.select("node", "hub", "authority")


def distances(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """source, node, hops (at most `most`) over edges in both directions. Without sources (node) from every node: its rows grow with the square of a component, so give a sample for large ones."""
    step = written(undirected(edges))
    first = (nodes(step) if sources is None else sources.select("node").distinct()).select(F.col("node").alias("source"), "node")
    seen = front = written(first.withColumn("hops", F.lit(0)))
    for hops in count(1) if most is None else range(1, most + 1):
        new = front.select("source", F.col("node").alias("src")).join(step, "src").select("source", F.col("dst").alias("node")).distinct()
        front = written(new.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def distance_centralities(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, closeness (scaled by the share reached), harmonic, eccentricity."""
    n = F.lit(nodes(edges).count())
    by = distances(edges, sources).filter("hops > 0").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reached"), F.sum("hops").alias("total"), F.sum(1.0 / F.col("hops")).alias("inverse"), F.max("hops").alias("eccentricity"))
    close = F.col("reached") / F.col("total") * F.col("reached") / (n - 1)
    return by.select("node", close.alias("closeness"), (F.col("inverse") / (n - 1)).alias("harmonic"), F.col("eccentricity").cast("long").alias("eccentricity"))


def total_neighbours(edges: DataFrame, source: int) -> DataFrame:
    """node, score: the size of the union of its neighbours and those of source."""
    both = written(undirected(edges))
    own = both.filter(F.col("src") == source).select("dst")
    size = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    shared = both.join(own, "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"))
    joined = size.filter(F.col("node") != source).join(shared, "node", "left").crossJoin(_one_row(own, F.count("*").alias("own")))  # one row
    return joined.select("node", (F.col("n") + F.col("own") - F.coalesce("m", F.lit(0))).alias("score"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean_degree, density, loops."""
    n = nodes(edges).agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(e).select("nodes", "edges", (F.col("edges") / F.col("nodes")).alias("mean_degree"), F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / pairs).otherwise(0.0).alias("density"), "loops")  # one row each


def _with_degrees(edges: DataFrame) -> DataFrame:
    both = undirected(edges)
    deg = both.groupBy("src").agg(F.count("*").alias("n"))
    return both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: the correlation of the degrees at the two ends of an edge."""
    return _with_degrees(edges).agg(F.corr("n", "m").alias("assortativity"))


def rich_club(edges: DataFrame) -> DataFrame:
    """degree, nodes and coefficient of the nodes of more neighbours than degree: the share of their pairs that are linked. Counts are by degree first, so only distinct degrees are summed along."""
    from pyspark.sql import Window

    linked = _with_degrees(edges).filter("src < dst").groupBy(F.least("n", "m").alias("d")).agg(F.count("*").alias("e"))
    held = undirected(edges).groupBy("src").agg(F.count("*").alias("d")).groupBy("d").agg(F.count("*").alias("v"))
    above = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    both = held.join(linked, "d", "left").select("d", F.coalesce(F.sum("v").over(above), F.lit(0)).alias("nodes"), F.coalesce(F.sum(F.coalesce("e", F.lit(0))).over(above), F.lit(0)).alias("edges"))
    return both.filter("nodes > 1").select(F.col("d").alias("degree"), "nodes", (2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("coefficient"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row, of groups (node, community): the sum of each community's share of edges inside, less the square of its share of ends."""
    both = undirected(edges).join(groups.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(groups.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    by = both.groupBy("a").agg(F.count_if(F.col("a") == F.col("b")).alias("inside"), F.count("*").alias("ends"))
    total = _one_row(by, F.sum("ends").alias("all"))
    return by.crossJoin(total).agg(F.sum(F.col("inside") / F.col("all") - F.pow(F.col("ends") / F.col("all"), 2)).alias("modularity"))  # one row


def conductance(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """community, conductance: edges that leave it, over the ends of the smaller side."""
    both = undirected(edges).join(groups.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(groups.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    by = both.groupBy("a").agg(F.count_if(F.col("a") != F.col("b")).alias("leave"), F.count("*").alias("ends"))
    total = _one_row(by, F.sum("ends").alias("all"))
    small = F.least("ends", F.col("all") - F.col("ends"))
    return by.crossJoin(total).select(F.col("a").alias("community"), F.when(small > 0, F.col("leave") / small).otherwise(0.0).alias("conductance"))  # one row
