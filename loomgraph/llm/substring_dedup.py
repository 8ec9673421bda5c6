"""Substring dedup (2): seed and extend over words.

Documents are joined on winnowed anchors of words, matches are extended to
both sides, and repeats of at least `length` words stay; see repeats.py.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, seqhash
from .repeats import Tokens, mask, repeated_spans

#: Words of an anchor. With 50 words a repeat, one word in 22 begins an anchor.
ANCHOR = 8


def substring_dedup(docs: DataFrame, length: int = 50, anchor: int = ANCHOR) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    Returns, for every row: doc_id, n_words, n_removed, kept_text (kept words
    joined by one space). Windows are judged on the input. Null and empty
    texts, and those of white space only, have no words; texts of fewer than
    `length` words lose none. Rows of one doc_id don't remove each other's words.
    """
    tokens = Tokens("words", min(anchor, length), length)
    docs = common.keyed(docs)
    spans = repeated_spans(docs, tokens)

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "_text", 1 << 22):
            n_words, n_removed, kept = [], [], []
            for text, at in zip(common.raw(part.column("_text")), part.column("spans").to_pylist(), strict=True):
                if at:
                    starts, ends, _ = seqhash.words(text)
                    gone = mask(at, len(starts), length)
                    n_words.append(len(starts))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]))
                else:
                    own = text.split()
                    n_words.append(len(own))
                    n_removed.append(0)
                    kept.append(b" ".join(own))
            yield pa.record_batch([part.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    out = common.map_arrow(docs.join(spans.hint("shuffle_hash"), ["_id", "_key"], "left").select("_id", "_text", "spans"), rows, "_id long, n_words long, n_removed long, kept_text string")
    return out.select(common.shown_id(), "n_words", "n_removed", "kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = substring_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win
  FROM words, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE doc_id > first
), covered AS (
  SELECT DISTINCT doc_id, i + j AS i FROM gone, range(0, 50) AS t(j)
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.i) AS t
  FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
