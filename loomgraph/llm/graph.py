"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of edges (a, b: long); nodes alone aren't listed.

    Large and small stars in turn: each node links its larger (then its smaller)
    neighbours to the least of them, until nothing changes; rounds grow with the
    logarithm of the longest path. A step is a minimum by node, combined before
    the shuffle, joined back, so no node's neighbours are gathered.
    """
    spark = edges.sparkSession
    now = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("shuffle_hash"), "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = common.written(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.discard(now)
        now = after
        if state == seen:
            break
        seen = state
    # every edge now leads from a node to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
