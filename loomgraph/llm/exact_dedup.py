"""Exact dedup (4): distributed MSD radix partitioning.

Documents are split by their first bytes, then what is left in groups of
several by the bytes that follow, and so on, with pieces that grow fourfold,
until each group has one document or has ended. Equality is that of the bytes
themselves; no digest decides it. A round is one grouping by (group, piece),
combined before the shuffle, so that thousands of copies send one row a task,
and a join that gives each document its new group; the grouped side of that
join has one row a key, so AQE can split the other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of the first piece; each next one is GROWTH times as long.
FIRST, GROWTH = 256, 4


def _normal(batch: pa.RecordBatch):
    for part in common.slices(batch, "text", 1 << 24):
        text = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
        held = text.cast(pa.binary() if pa.types.is_string(text.type) else pa.large_binary())
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in held])
        yield pa.record_batch([part.column("doc_id"), held.cast(pa.binary()), sha], names=["doc_id", "rest", "text_sha256"])


def exact_dedup(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns, for every row: doc_id, keep_id (the largest doc_id of the group),
    group_size, kept, text_sha256 (of the normalised text). Null texts are empty
    and so equal to empty ones. Of rows that tie for the largest doc_id, one
    stays; a null doc_id is smaller than any other here, so that its row stays
    only where no other can.
    """
    spark = docs.sparkSession
    rows = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _normal, "doc_id long, rest binary, text_sha256 string")
    now = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(0).cast("long").alias("grp"), "text_sha256", "rest")
    done, piece = [], first
    while True:
        now = now.select("row", "doc_id", "grp", "text_sha256", F.substring("rest", 1, piece).alias("piece"), F.expr(f"substring(rest, {piece + 1})").alias("rest"))
        groups = now.groupBy("grp", "piece").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max("row").alias("next"))
        split = now.join(groups, ["grp", "piece"])
        ended = (F.col("group_size") == 1) | (F.octet_length("piece") < piece)
        table = common.written(
            split.select("row", "doc_id", F.col("next").alias("grp"), "text_sha256", F.when(~ended, F.col("rest")).alias("rest"), "group_size", "keep_id", ended.alias("ended")), by="ended"
        )
        done.append(table.filter("ended").select("row", "doc_id", "grp", "keep_id", "group_size", "text_sha256"))
        now = table.filter("not ended").select("row", "doc_id", "grp", "text_sha256", "rest")
        if not now.limit(1).count():
            break
        piece *= growth
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # of rows that share the largest doc_id, the last one stays
    tied = out.filter(F.col("group_size") > 1).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("grp").agg(F.max("row").alias("kept_row"))
    return (
        out.join(tied, "grp", "left")
        .select("doc_id", "keep_id", "group_size", ((F.col("group_size") == 1) | F.col("row").eqNullSafe(F.col("kept_row"))).alias("kept"), "text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
