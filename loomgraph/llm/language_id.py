"""Language ID (1): rank-order profiles.

A profile is the list of a language's most frequent 1- to 3-grams of letters,
by rank. A document's own list is compared to each by the out-of-place
distance: the sum of how far each of its n-grams is from its place in the
profile, or the profile's length where it isn't in it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: n-grams of a profile; documents a language's profile is learned from, about (of languages with fewer, all).
PROFILE, SAMPLE = 300, 2000
#: Languages that may be learned, which bounds the profiles on the driver and in the broadcast (4 kB or so each); more are refused, never left out.
LANGUAGES = 10_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code of each character of the basic plane: itself if it is a letter, else 1, which parts words."""
    return np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 1 for c in range(1 << 16)], np.uint64)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) and c.max() >= 1 << 16:  # letters beyond the basic plane share the codes of its surrogates
        far = np.flatnonzero(c >= 1 << 16)
        values, back = np.unique(c[far], return_inverse=True)
        letter = np.array([chr(v).isalpha() for v in values])[back]
        c = c.copy()
        c[far] = np.where(letter, 0xD800 + c[far] % 0x800, 32)
        codes = _letters()[c]
        codes[far[letter]] = c[far[letter]]
        return codes
    return _letters()[c]


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of all 1- to 3-grams of letters, with a blank before and after each word, sorted by text and n-gram."""
    lengths = np.array([len(t) + 1 for t in texts])
    lower = [t.lower() for t in texts]
    if any(len(a) != len(b) for a, b in zip(texts, lower, strict=True)):
        lengths = np.array([len(t) + 1 for t in lower])
    c = _codes(" " + " ".join(lower) + " ")
    d = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)]).astype(np.uint64)
    stay = np.r_[True, (c[1:] > 1) | (c[:-1] > 1)]
    c, d = c[stay], d[stay] << np.uint64(48)
    a, b = c[:-1], c[1:]
    letter = c > 1
    two = (d[1:] * (~letter[:-1]) + d[:-1] * letter[:-1]) | (a << np.uint64(16)) | b
    middle = letter[1:-1]
    three = (d[1:-1] | (c[:-2] << np.uint64(32)) | (c[1:-1] << np.uint64(16)) | c[2:])[middle]
    keys = np.concatenate([(d | c)[letter], two[letter[:-1] | letter[1:]], three])
    keys.sort()
    if not len(keys):
        return keys.astype(np.int64), keys, keys.astype(np.int64)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[head, len(keys)])
    return (keys[head] >> np.uint64(48)).astype(np.int64), keys[head] & np.uint64((1 << 48) - 1), count


def _learned(rows: DataFrame, size: int, sample: int, languages: int) -> dict[str, np.ndarray]:
    """Profiles of the languages of rows (doc_id, text, lang). Only the profiles come to the driver."""
    many = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if (found := many.count()) > languages:
        raise ValueError(f"{found} languages, where {languages} may be learned")
    # a share of each language by a hash of the id: about `sample` documents
    dealt = (F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64) + 0.5) < F.lit(float(sample)) / F.col("n")
    taken = rows.join(F.broadcast(many), "lang").filter(dealt).select("lang", "text")

    def count(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = [t for t, x in zip(part.column("text").to_pylist(), langs, strict=True) if x == lang]
                _, gram, n = ngram_counts(texts)
                values, back = np.unique(gram, return_inverse=True)
                yield pa.record_batch([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(np.bincount(back, n, len(values)).astype(np.int64))], names=["lang", "gram", "n"])

    counted = common.map_arrow(taken, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    out: dict[str, list] = {}
    for x in ranked.collect():  # `size` rows a language at most
        out.setdefault(x["lang"], []).append((x["rank"], x["gram"]))
    return {lang: np.array([g for _, g in sorted(own)], np.int64).view(np.uint64) for lang, own in sorted(out.items())}


class Profiles:
    """Learned profiles as one table of ranks: n-grams by languages, absent ones at the profile's length."""

    def __init__(self, by: dict[str, np.ndarray], size: int):
        self.size, self.langs = size, list(by)
        self.grams = np.unique(np.concatenate([*by.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, max(1, len(by))), size, np.int32)
        for n, own in enumerate(by.values()):
            self.ranks[np.searchsorted(self.grams, own), n] = np.arange(len(own))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        doc, gram, count = ngram_counts(texts)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(doc) or not self.langs:
            return langs, scores
        order = np.argsort((doc << 32) + ((1 << 32) - 1 - count), kind="stable")  # gram breaks ties
        doc, gram = doc[order], gram[order]
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(doc)) - np.repeat(head, np.diff(np.r_[head, len(doc)]))
        top = rank < self.size
        doc, gram, rank = doc[top], gram[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at[self.grams[at] != gram] = len(self.grams)
        place = self.ranks[at]
        far = np.where(place < self.size, np.abs(place - rank[:, None]), self.size)
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total = np.add.reduceat(far, head, axis=0)
        best = total.argmin(axis=1)
        share = 1 - total[np.arange(len(head)), best] / (np.diff(np.r_[head, len(doc)]) * self.size)
        for n, lang, score in zip(doc[head].tolist(), best.tolist(), share.tolist(), strict=True):
            langs[n], scores[n] = self.langs[lang], score
        return langs, scores


def identify_language(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """The language of every whole text, by profiles learned from documents whose crc32(doc_id) mod 5 isn't 0.

    Returns, for every row: doc_id, held_out, lang_pred, score (1 less the
    distance as a share of the largest possible). A text that is null or has no
    letter is `und` at score 0, as is every text where nothing could be learned.
    Ties go to the first language by name. Rows without a doc_id count as not
    held out, but nothing is learned from them. Profiles are learned from about
    `sample` documents a language, taken by a hash of the id, at any input size.
    ValueError where there are more than `languages` of them.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = docs.filter(F.col("doc_id").isNotNull() & ~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    profiles = docs.sparkSession.sparkContext.broadcast(Profiles(_learned(known, size, sample, languages), size))  # size n-grams a language

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "text", 1 << 19):
            langs, scores = profiles.value.predict([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(common.documents(spark, sf_dir))
