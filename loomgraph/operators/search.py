"""Full-text scores and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..storage import written


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: lower-case runs of letters and digits, counted in each document."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _occurrences(low: Column, term: str) -> Column:
    """How often a term stands in a lower-case text as a word of its own."""
    whole = rf"(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])"
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(whole))).otherwise(0)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold a query term. Lengths and counts of terms come from one scan by regular expressions; what is kept of it is a few numbers a document."""
    low = F.lower(text)
    base = written(docs.select(key, F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("size"), *[_occurrences(low, t).alias(f"tf{n}") for n, t in enumerate(query)]))
    stats = base.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.sum((F.col(f"tf{n}") > 0).cast("int")).alias(f"df{n}") for n in range(len(query))])
    joined = base.filter(" or ".join(f"tf{n} > 0" for n in range(len(query)))).crossJoin(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for n in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{n}") + 0.5) / (F.col(f"df{n}") + 0.5))
        tf = F.col(f"tf{n}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.select(key, score.alias("score"))


def nearest(rows: DataFrame, key: str, vector: str, target: list[float], k: int) -> DataFrame:
    """key, distance of the k vectors nearest to target: a scan and a top-k, no shuffle of the vectors."""
    return rows.select(key, vectors.l2_distance(vectors.doubles(F.col(vector)), F.array(*map(F.lit, target))).alias("distance")).orderBy("distance", key).limit(k)
