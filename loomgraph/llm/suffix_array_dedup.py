"""Suffix-array dedup (6): common-prefix intervals over bytes.

The suffixes that are sorted are those that begin at an anchor, which every
repeat of `length` bytes holds (repeats.py); contexts equal to both sides are
merged first, so that intervals are left-diverse, and those of one anchor form
an enhanced suffix array with its common-prefix intervals, scanned depth by
depth together with the array of what precedes the anchors. All occurrences
of a repeat are found, not just neighbours in the array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .repeats import Tokens, lcp_intervals, mask, repeated_spans

#: Bytes of an anchor.
ANCHOR = 16


def suffix_array_dedup(docs: DataFrame, length: int = 50, anchor: int = ANCHOR) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    Returns, for every row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (the remaining bytes, which may no longer be UTF-8).
    Matches never cross documents; strings are judged on the input. A null text
    is empty; texts shorter than `length` lose nothing; rows of one doc_id don't
    remove each other's bytes.
    """
    tokens = Tokens("bytes", min(anchor, length), length)
    docs = common.keyed(docs)
    spans = repeated_spans(docs, tokens)

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "_text", 1 << 22):
            out = []
            for text, at in zip(common.raw(part.column("_text")), part.column("spans").to_pylist(), strict=True):
                if at:
                    gone = mask(at, len(text), length)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0, kept))
                else:
                    out.append((len(text), 0, 0, text))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([part.column("_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = common.map_arrow(docs.join(spans.hint("shuffle_hash"), ["_id", "_key"], "left").select("_id", "_text", "spans"), rows, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(common.shown_id(), "n_bytes", "n_removed", "n_spans", "kept")


def maximal_repeats(texts: list[bytes], length: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least `length` bytes of a small collection, each with all its (text, offset) occurrences.

    An enhanced suffix array of all suffixes, one stack scan over its common
    prefixes, and of each interval the test that what precedes its suffixes
    differs (else the repeat extends to the left).
    """
    order = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t)))
    lcp = np.zeros(len(order), np.int64)
    for j in range(1, len(order)):
        a, b = order[j - 1][0], order[j][0]
        n = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
        lcp[j] = differ[0] if len(differ) else n
    out = []
    for depth, first, last in lcp_intervals(lcp):
        if depth >= length:
            before = [(texts[n][i - 1] if i else None) for _, n, i in order[first : last + 1]]
            if None in before or len(set(before)) > 1:
                out.append((order[first][0][:depth], sorted((n, i) for _, n, i in order[first : last + 1])))
    return sorted(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = suffix_array_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS win
  FROM bytes, unnest(range(0, greatest(CAST(length(x) / 2 AS BIGINT) - 49, 0))) AS t(i)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE doc_id > first
), covered AS (
  SELECT DISTINCT doc_id, i + j AS i FROM gone, range(0, 50) AS t(j)
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (lag IS NULL OR lag < i - 1) AS n_spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS lag FROM covered) GROUP BY doc_id
), placed AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS b FROM bytes, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS t(i)
), kept AS (
  SELECT p.doc_id, string_agg(p.b, '' ORDER BY p.i) AS x
  FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
)
SELECT b.doc_id, CAST(length(b.x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
FROM bytes b LEFT JOIN runs r ON b.doc_id = r.doc_id LEFT JOIN kept k ON b.doc_id = k.doc_id
"""
