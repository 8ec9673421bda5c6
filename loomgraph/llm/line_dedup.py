"""Line dedup (10): deletion-neighbourhood join.

Two lines are near when one edit of a character at most turns one into the
other. Lines that are equal fall together first. A near line shares the first
or the last half, up to the edit, of its partner, so that only lines which
share such a half with another one go on; of these all variants with one
character deleted are emitted as hashed keys, with the place of the deletion:

* two lines of one length that lack the same place and are equal then differ
  in that place only;
* a line that lacks one place and equals another whole line has one more.

Variants are joined by a grouping that is combined before the shuffle, and the
earliest line of each key is what the others are verified against, by edit
distance on the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, seqhash

#: Characters below which lines are dropped only when equal: one edit makes another word of a short one.
FUZZY = 16
_BLANK = " \t\r\v\f"


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _half_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Line number and key of the halves of lines, of which two near lines share one at least: hash, length and side of a half."""
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    starts, sums = ends - sizes, seqhash.prefix(_characters("".join(lines)))
    numbers, keys = [], []
    for q, wanted in ((sizes // 2, np.ones(len(sizes), bool)), ((sizes - 1) // 2, sizes % 2 == 0)):
        n = np.flatnonzero(wanted)
        for a, b, side in ((starts, starts + q, 0), (ends - q, ends, 1)):
            numbers.append(n)
            keys.append(seqhash.mix(seqhash.span(sums, a[n], b[n]) + np.uint64(side)))
    return np.concatenate(numbers), np.concatenate(keys)


def _characters(line: str) -> np.ndarray:
    return seqhash.mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(0x51ED27))


def _line_rows(batch: pa.RecordBatch):
    """Of each line that isn't blank: two hashes, and where it stands."""
    for part in common.slices(batch, "_text"):
        out = []
        for text, i, key in zip(part.column("_text").to_pylist(), part.column("_id").to_pylist(), part.column("_key").to_pylist(), strict=True):
            for no, line in enumerate(_lines(text)):
                line = line.strip(_BLANK)
                if line:
                    a, b = np.frombuffer(hashlib.md5(line.encode()).digest(), np.int64).tolist()
                    out.append((a, b, i, key, no))
        for a in range(0, len(out), 20_000):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out[a : a + 20_000], strict=True)], names=["l1", "l2", "_id", "_key", "no"])


def _first_rows(fuzzy: int, what: str):
    """Of the lines listed for a document (no, l1, l2) that have `fuzzy` characters: their half keys, or their texts."""

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "_text", 1 << 19):
            out, lines = [], []
            for text, i, key, at in zip(part.column("_text").to_pylist(), part.column("_id").to_pylist(), part.column("_key").to_pylist(), part.column("at").to_pylist(), strict=True):
                own = _lines(text)
                for x in at:
                    line = own[x["no"]].strip(_BLANK)
                    if len(line) >= fuzzy:
                        out.append((x["l1"], x["l2"], i, key, x["no"]))
                        lines.append(line)
            if not out:
                continue
            names = ["l1", "l2", "_id", "_key", "no"]
            held = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
            if what == "text":
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(lines, pa.string())], names=[*names, "line"])
            else:
                number, half = _half_keys(lines)
                held = held.take(pa.array(number))
                yield pa.RecordBatch.from_arrays([pa.array(half.view(np.int64)), *held.columns], names=["half", *names])

    return rows


def _variant_rows(batch: pa.RecordBatch):
    """Keys of a line: each place with the rest, the rest alone (role 1), and the whole (role 0)."""
    for part in common.slices(batch, "line", 1 << 17):
        out = []
        for n, line in enumerate(part.column("line").to_pylist()):
            v = _characters(line)
            m = len(v)
            sums, twice = seqhash.prefix(v), seqhash.prime_prefix(v)
            at = np.arange(m)
            # the part after the deletion moves one place to the left
            one = sums[:m] + (sums[m] - sums[1:]) * seqhash.powers(2)[1][1]
            two = seqhash.prime_rest(seqhash.prime_rest(twice[:m]) + seqhash.prime_rest(twice[m] - twice[1:]) * seqhash.prime_powers(2)[1][1])
            keys = [(seqhash.mix(one + np.uint64(m - 1)), seqhash.mix(sums[m:] + np.uint64(m))), (seqhash.mix(two + np.uint64(m - 1)), seqhash.mix(seqhash.prime_rest(twice[m:]) + np.uint64(m)))]
            place = seqhash.mix(at.astype(np.uint64) + np.uint64(m) * np.uint64(1 << 32))
            # equal neighbours give equal variants: one of them will do for the rest alone
            some = np.r_[True, v[1:] != v[:-1]]
            for k1, k2, role in ((keys[0][0] ^ place, keys[1][0], 2), (keys[0][0][some], keys[1][0][some], 1), (keys[0][1], keys[1][1], 0)):
                out.append((k1, k2, np.full(len(k1), role, np.int32), np.full(len(k1), n)))
        k1, k2, role, n = map(np.concatenate, zip(*out, strict=True))
        pick = pa.array(n)
        yield pa.record_batch([k1.view(np.int64), k2.view(np.int64), pa.array(role), *(part.column(c).take(pick) for c in ("l1", "l2", "_id", "_key", "no"))], names=["k1", "k2", "role", "l1", "l2", "_id", "_key", "no"])


def _place() -> F.Column:
    return F.struct("_id", "_key", "no")


def near_lines(docs: DataFrame, fuzzy: int = FUZZY) -> tuple[DataFrame, DataFrame]:
    """Of keyed docs: the distinct lines with their first places (l1, l2, _id, _key, no), and those of them (l1, l2) that an earlier line is near to."""
    spark = docs.sparkSession
    rows = common.map_arrow(docs.select("_id", "_key", "_text"), _line_rows, "l1 long, l2 long, _id long, _key long, no long")
    first = common.written(rows.groupBy("l1", "l2").agg(F.min(_place()).alias("at")).select("l1", "l2", "at.*"))
    text = docs.select("_id", "_key", "_text")

    def from_documents(lines: DataFrame, what: str, schema: str) -> DataFrame:
        at = lines.groupBy("_id", "_key").agg(F.collect_list(F.struct("no", "l1", "l2")).alias("at"))
        return common.map_arrow(text.join(at.hint("shuffle_hash"), ["_id", "_key"]).select("_id", "_key", "_text", "at"), _first_rows(fuzzy, what), schema)

    halves = common.written(from_documents(first, "halves", "half long, l1 long, l2 long, _id long, _key long, no long"))
    several = halves.groupBy("half").agg(F.min("l1").alias("a"), F.max("l1").alias("b")).filter("a < b").select("half")
    likely = halves.join(several.hint("shuffle_hash"), "half", "left_semi").select("l1", "l2", "_id", "_key", "no").distinct()
    lines = common.written(from_documents(likely, "text", "l1 long, l2 long, _id long, _key long, no long, line string"))
    common.discard(halves)

    variants = common.map_arrow(lines, _variant_rows, "k1 long, k2 long, role int, l1 long, l2 long, _id long, _key long, no long")
    # plain minima combine in memory; those of structs are for the few keys that several lines have
    common_keys = variants.groupBy("k1", "k2").agg(F.min("l1").alias("a"), F.max("l1").alias("b")).filter("a < b").select("k1", "k2")
    packed = common.written(variants.join(common_keys.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "role", "l1", "l2", _place().alias("at")))
    earliest = packed.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("role") == 0, F.struct("at", "l1", "l2"))).alias("whole"),
        F.min(F.when(F.col("role") != 0, F.struct("at", "l1", "l2"))).alias("lacking"),
    )
    met = packed.join(earliest.hint("shuffle_hash"), ["k1", "k2"])
    other = F.when(F.col("role") == 1, F.col("whole")).otherwise(F.col("lacking"))
    pairs = met.select("l1", "l2", "at", other.alias("other")).filter("other.at < at").select("l1", "l2", F.col("other.l1").alias("m1"), F.col("other.l2").alias("m2")).distinct()
    texts = lines.select("l1", "l2", "line")
    others = texts.select(F.col("l1").alias("m1"), F.col("l2").alias("m2"), F.col("line").alias("earlier"))
    gone = pairs.join(texts, ["l1", "l2"]).join(others, ["m1", "m2"]).filter(F.levenshtein("line", "earlier", 1) >= 0).select("l1", "l2").distinct()
    return first, gone


def line_dedup(docs: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """Drop each line that is near an earlier one: equal, or, from `fuzzy` characters on, within one edit of a character.

    Lines are what stands between line feeds, compared without the blanks at
    their ends; earlier means a smaller (doc_id, line number) of the input,
    whether that line stays itself or not. Blank lines are never dropped.
    Returns docs with all their columns, `text` without the dropped lines (null
    stays null), and n_lines and n_removed unless docs has columns of such names.
    """
    names = docs.columns
    base = common.rowed(docs)
    first, gone = near_lines(base, fuzzy)
    kept = first.join(gone, ["l1", "l2"], "left_anti").groupBy("_id", "_key").agg(F.collect_list("no").alias("kept"))

    def rows(batch: pa.RecordBatch):
        texts, n_lines, n_removed = [], [], []
        for text, kept in zip(batch.column("_text").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            lines, stay = _lines(text), set(kept or ())
            left = [x for n, x in enumerate(lines) if n in stay or not x.strip(_BLANK)]
            n_lines.append(len(lines) if text else 0)
            n_removed.append(len(lines) - len(left))
            texts.append("\n".join(left))
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["_row", "_text", "n_lines", "n_removed"])

    joined = base.join(kept.hint("shuffle_hash"), ["_id", "_key"], "left").select("_row", "_text", "kept")
    out = common.map_arrow(joined, rows, T.StructType([joined.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    extra = [F.col(c) for c in ("n_lines", "n_removed") if c not in names]
    return out.select(*common.unrowed(names), *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, text FROM documents
), raw AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM split
), lines AS (
  SELECT doc_id, part, no, trim(part, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw
), firsts AS (
  SELECT line, min({'d': doc_id, 'n': no}) AS at FROM lines WHERE line <> '' GROUP BY line
), near AS (
  SELECT DISTINCT a.line FROM firsts a JOIN firsts b
    ON length(b.line) BETWEEN length(a.line) - 1 AND length(a.line) + 1 AND b.at < a.at
   AND (left(a.line, (length(a.line) - 1) // 2) = left(b.line, (length(a.line) - 1) // 2) OR right(a.line, (length(a.line) - 1) // 2) = right(b.line, (length(a.line) - 1) // 2))
  WHERE length(a.line) >= 16 AND length(b.line) >= 16 AND levenshtein(a.line, b.line) <= 1
), kept AS (
  SELECT l.doc_id, l.no, l.part FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
  WHERE l.line = '' OR (n.line IS NULL AND f.at = {'d': l.doc_id, 'n': l.no})
), joined AS (
  SELECT doc_id, string_agg(part, chr(10) ORDER BY no) AS t, count(*) AS n FROM kept GROUP BY doc_id
)
SELECT s.doc_id, CAST(CASE WHEN coalesce(s.text, '') = '' THEN 0 ELSE len(s.parts) END AS BIGINT) AS n_lines,
       CAST(len(s.parts) - coalesce(j.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.t, '')) AS kept_sha256
FROM split s LEFT JOIN joined j ON s.doc_id = j.doc_id
"""
