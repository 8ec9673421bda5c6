"""Structure of graphs: strong components, orders, cycles, trees, trusses, colours, walks. Edge tables are (src, dst: long)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .algorithms import connected_components, nodes, undirected


def _spread(step: DataFrame, label: DataFrame) -> DataFrame:
    """node, label: the least label of any node that leads here, its own included."""
    while True:
        got = step.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        both = written(label.join(got, "node", "left").select("node", "label", F.least("label", "new").alias("next")))
        moved = both.filter("next < label").limit(1).count()
        label = both.select("node", F.col("next").alias("label"))
        if not moved:
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node).

    Each round the least node that leads to a node is its colour; what a colour's
    own node can be reached from, within the colour, is its component, and leaves.
    """
    step = written(edges.select("src", "dst").filter("src <> dst").distinct())
    left = written(nodes(edges))
    done: DataFrame | None = None
    while True:
        colour = _spread(step, left.withColumn("label", F.col("node")))
        inside = step.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst").filter("label = other").select("src", "dst", "label")
        inside = written(inside)
        found = front = written(colour.filter("node = label"))
        while True:
            new = inside.join(front.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct().join(found, ["node", "label"], "left_anti")
            front = written(new)
            if not front.limit(1).count():
                break
            found = found.unionByName(front)
        found = written(found)
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, "node", "left_anti"))
        if not left.limit(1).count():
            break
        step = written(step.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done.select("node", F.col("label").alias("component"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: the length of the longest path to it; null for nodes of a cycle and those beyond one. Ordering by level and node is a topological order."""
    step = written(edges.select("src", "dst").distinct())
    left = written(nodes(step))
    done: DataFrame | None = None
    for level in count():
        ready = written(left.join(step.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            break
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "node", "left_anti"))
        step = written(step.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """node of every node on a cycle: in a strong component of several, or with a loop."""
    strong = written(strong_components(edges))
    several = strong.groupBy("component").count().filter("count > 1").select("component")
    return strong.join(several, "component", "left_semi").select("node").union(edges.filter("src = dst").select("src")).distinct()


def longest_paths(edges: DataFrame) -> DataFrame:
    """node, length of the longest path that ends there, in edges; of an acyclic graph."""
    return topological_levels(edges).filter("level is not null").select("node", F.col("level").cast("long").alias("length"))


def bipartite(edges: DataFrame) -> DataFrame:
    """node, side (0 or 1), null where the node's component isn't bipartite. Ids beyond 2**62 are refused.

    Every node stands twice, once for each side, and edges cross sides; a
    component is bipartite unless that joins a node's two stands.
    """
    if not edges.filter((F.abs("src") >= 2**62) | (F.abs("dst") >= 2**62)).isEmpty():
        raise ValueError("ids of 2**62 and more")
    both = undirected(edges)
    doubled = both.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    loops = edges.filter("src = dst").select((F.col("src") * 2).alias("src"), (F.col("src") * 2 + 1).alias("dst"))
    part = written(connected_components(doubled.unionByName(loops)))
    zero = part.filter("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("node"), F.col("component").alias("zero"))
    one = part.filter("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("long").alias("node"), F.col("component").alias("one"))
    side = F.when(F.col("zero") == F.col("one"), None).otherwise((F.col("zero") > F.col("one")).cast("int"))
    return zero.join(one, "node").select("node", side.alias("side"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, weight of a minimum spanning forest of edges (src, dst, weight), by Boruvka's rounds; ties go to the lesser ends."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = written(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    live = written(e.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken: DataFrame | None = None
    while live.limit(1).count():
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), F.struct("weight", "src", "dst", "a", "b").alias("edge"))
        best = written(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        new = best.select("src", "dst", "weight")
        taken = new if taken is None else taken.unionByName(new)
        part = written(connected_components(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        joined = live.join(part.select(F.col("node").alias("a"), F.col("component").alias("p")), "a").join(part.select(F.col("node").alias("b"), F.col("component").alias("q")), "b")
        live = written(joined.filter("p <> q").select("src", "dst", "weight", F.col("p").alias("a"), F.col("q").alias("b")))
    return e.limit(0) if taken is None else taken


def k_truss(edges: DataFrame, k: int = 3) -> DataFrame:
    """src, dst (src < dst) of the edges left when each is in k - 2 triangles or more of what is left."""
    now = written(undirected(edges).filter("src < dst"))
    if k <= 2:
        return now
    both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    deg = both.groupBy("src").agg(F.count("*").alias("n"))
    # from the end of fewer neighbours, so that a hub's neighbours are never paired; the triangles are listed once, then peeled
    ranked = written(both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst").filter("struct(n, src) < struct(m, dst)").select("src", "dst"))
    found = ranked.toDF("x", "y").join(ranked.toDF("x", "z"), "x").filter("y <> z").join(ranked.toDF("y", "z"), ["y", "z"])
    side = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    left = written(found.select(side("x", "y").alias("a"), side("x", "z").alias("b"), side("y", "z").alias("c")))
    while True:
        weak = now.join(left.select(F.explode(F.array("a", "b", "c")).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("n")), ["src", "dst"], "left").filter(F.coalesce("n", F.lit(0)) < k - 2)
        weak = written(weak.select("src", "dst"))
        if weak.isEmpty():
            return now
        now = written(now.join(weak, ["src", "dst"], "left_anti"))
        gone = weak.select(F.struct("src", "dst").alias("gone"))
        for c in ("a", "b", "c"):
            left = left.join(gone, F.col(c) == F.col("gone"), "left_anti")
        left = written(left)


def colouring(edges: DataFrame) -> DataFrame:
    """node, colour, no two neighbours alike, until every node has one: each round the nodes that come before all their uncoloured neighbours, by a hash, take the least free colour."""
    both = written(undirected(edges))
    left = written(both.select(F.col("src").alias("node")).distinct())
    done = left.limit(0).withColumn("colour", F.lit(0))
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while left.limit(1).count():
        open_ = both.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
        blocked = open_.filter(order("dst") < order("src")).select(F.col("src").alias("node")).distinct()
        ready = left.join(blocked, "node", "left_anti")
        used = both.join(done.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").distinct().groupBy("node").agg(F.collect_set("colour").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))  # colours used are fewer than the most neighbours
        new = written(ready.join(used, "node", "left").select("node", F.coalesce(free, F.lit(0)).alias("colour")))
        done = done.unionByName(new)
        left = written(left.join(new, "node", "left_anti"))
    return done


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """start, nodes: from each of starts (node) a walk along edges out, each step taken by a hash of walk, step and node, so that a repeated task takes the same way."""
    step = written(edges.select("src", "dst"))
    walk = starts.select(F.col("node").alias("start"), F.array("node").alias("nodes"))
    for i in range(steps):
        at = walk.withColumn("src", F.element_at("nodes", -1))
        pick = at.join(step, "src", "left").groupBy("start", "nodes").agg(F.min_by("dst", F.struct(F.xxhash64("start", F.lit(seed), F.lit(i), "dst"), "dst")).alias("dst"))
        walk = written(pick.select("start", F.when(F.col("dst").isNull(), F.col("nodes")).otherwise(F.array_append("nodes", F.col("dst"))).alias("nodes")))
    return walk


def bellman_ford(edges: DataFrame, source: int) -> DataFrame:
    """node, cost from source over edges (src, dst, weight), which may be negative; ValueError where a negative cycle keeps costs falling."""
    step = written(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    n = nodes(step).count()
    best = front = written(edges.sparkSession.createDataFrame([(source, 0.0)], "node long, cost double"))
    for _ in range(n):
        new = front.join(step.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        both = written(best.join(new, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("moved")))
        best, front = both.select("node", "cost"), both.filter("moved").select("node", "cost")
        if not front.limit(1).count():
            return best
    raise ValueError("a negative cycle")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, score: over all sources (node) and targets, the share of shortest paths along edges that pass the node, its own ends left out.

    A row stands for each source and node that it reaches, so give a sample of
    sources on large graphs. Levels out count paths, the same levels back share
    the dependencies.
    """
    step = written(edges.select("src", "dst").filter("src <> dst").distinct())
    every = written(nodes(edges))
    start = every if sources is None else sources
    front = written(start.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front
    for depth in count(1):
        new = front.join(step.withColumnRenamed("src", "node"), "node").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths")).join(seen, ["source", "node"], "left_anti")
        front = written(new.select("source", "node", F.lit(depth).alias("depth"), "paths"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front)
    share: DataFrame | None = None  # source, node, delta of one level
    total: DataFrame | None = None
    for level in range(len(levels) - 1, 0, -1):
        far = levels[level] if share is None else levels[level].join(share, ["source", "node"], "left")
        part = (1 + (F.lit(0.0) if share is None else F.coalesce("delta", F.lit(0.0)))) / F.col("paths")
        into = far.select("source", F.col("node").alias("dst"), part.alias("part")).join(step, "dst").select("source", F.col("src").alias("node"), "part")
        share = written(levels[level - 1].join(into, ["source", "node"]).groupBy("source", "node", "paths").agg(F.sum("part").alias("part")).select("source", "node", (F.col("paths") * F.col("part")).alias("delta")))
        if level > 1:
            total = share if total is None else total.unionByName(share)
    if total is None:
        return every.withColumn("score", F.lit(0.0))
    return every.join(total.groupBy("node").agg(F.sum("delta").alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def bridges(edges: DataFrame) -> DataFrame:
    """src, dst (src < dst) of the edges whose loss parts their component; parallel edges are no bridges.

    Edges outside a breadth-first tree carry a random 64-bit mark at both ends; a
    tree edge is a bridge if the marks below it cancel, wrong once in 2^64 edges.
    The rounds are the depth of the tree, down and up again.
    """
    flat = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    once = written(flat.groupBy("src", "dst").agg(F.count("*").alias("n")))
    both = written(undirected(once))
    front = written(connected_components(once).select("component").distinct().select(F.col("component").alias("node"), F.lit(None).cast("long").alias("parent")))
    levels, seen = [front], front
    while True:
        new = both.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")).join(seen, "node", "left_anti")
        front = written(new)
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front)
    tree = seen.filter("parent is not null").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    loose = once.join(tree, ["src", "dst"], "left_anti").unionByName(once.filter("n > 1"))
    # parallel edges count as one of the tree and one beside it
    mark = F.xxhash64("src", "dst")
    held = written(loose.select(F.explode(F.array("src", "dst")).alias("node"), mark.alias("mark")).groupBy("node").agg(F.bit_xor("mark").alias("mark")))
    found: DataFrame | None = None
    below: DataFrame | None = None
    for level in reversed(levels[1:]):
        own = level.join(held, "node", "left").select("node", "parent", F.coalesce("mark", F.lit(0).cast("long")).alias("mark"))
        if below is not None:
            own = own.join(below, "node", "left").select("node", "parent", F.col("mark").bitwiseXOR(F.coalesce("sent", F.lit(0).cast("long"))).alias("mark"))
        own = written(own)
        below = own.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("mark").alias("sent"))
        one = own.filter("mark = 0").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
        found = one if found is None else found.unionByName(one)
    return once.select("src", "dst").limit(0) if found is None else found


def simple_paths(edges: DataFrame, source: int, target: int, most: int = 4) -> DataFrame:
    """nodes, length of every path from source to target of at most so many hops, no node twice."""
    step = edges.select("src", "dst").distinct()
    now = edges.sparkSession.createDataFrame([([source],)], "nodes array<long>")
    found: DataFrame | None = None
    for _ in range(most):
        now = now.join(step, F.element_at("nodes", -1) == F.col("src")).filter(~F.array_contains("nodes", F.col("dst"))).select(F.array_append("nodes", F.col("dst")).alias("nodes"))
        there = now.filter(F.element_at("nodes", -1) == target)
        found = there if found is None else found.unionByName(there)
        now = now.filter(F.element_at("nodes", -1) != target)
    assert found is not None
    return found.select("nodes", (F.size("nodes") - 1).cast("long").alias("length"))


def neighbour_knn(edges: DataFrame, k: int = 10) -> DataFrame:
    """node, other, similarity: for each node the k others whose neighbours overlap with its own most, by Jaccard; ties go to the lesser node."""
    both = written(undirected(edges))
    deg = both.groupBy("src").agg(F.count("*").alias("n"))
    met = both.toDF("node", "via").join(both.toDF("other", "via"), "via").filter("node <> other").groupBy("node", "other").agg(F.count("*").alias("common"))
    scored = met.join(deg.toDF("node", "a"), "node").join(deg.toDF("other", "b"), "other").select("node", "other", (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("similarity"))
    w = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")
