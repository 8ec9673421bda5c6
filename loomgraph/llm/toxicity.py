"""Toxicity (9): averaged subword embeddings into a linear softmax.

A word is the bag of its character n-grams; their embeddings are averaged and
a linear softmax tells how toxic the word is. Embeddings and softmax are
trained together in numpy, on documents: a document is as toxic as the words
it gives most weight to. Misspelt words share n-grams, and so vectors, with
those that were seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, seqhash

#: Bytes of an n-gram, with a blank on either side of a word; buckets of the embedding table; its width.
GRAMS, BUCKETS, WIDTH = (3, 4, 5, 6), 1 << 17, 8
#: Bound of the training sample: labelled documents of label 1, about; twice as many of label 0.
SAMPLE = 1500
EPOCHS = 120
#: Words whose n-grams are worked on at once in training.
BLOCK = 1 << 15
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c in b"@$!*" else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case; all that isn't a letter, a digit or one of @$!* (they stand in for letters) parts words."""
    return b" " + text.lower().encode().translate(_FOLD) + b" "


def subwords(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and bucket of each n-gram of a folded text, and the starts of its words."""
    b = np.frombuffer(text, np.uint8)
    blank = b == 32
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    word = np.cumsum(~blank & np.r_[True, blank[:-1]]) - 1
    sums = seqhash.prefix(seqhash.BYTE[b])
    blanks = np.r_[0, np.cumsum(blank)]
    words, buckets = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero(blanks[n - 1 : n - 1 + m] == blanks[1 : 1 + m])  # no blank inside
        words.append(word[at + 1])
        buckets.append((seqhash.span(sums, at, at + n) & np.uint64(BUCKETS - 1)).astype(np.int32))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), start
    return np.concatenate(words), np.concatenate(buckets), start


class Model:
    """What is left of a trained model: each bucket's logit (its embedding in the softmax's direction), and the bias."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits.astype(np.float32), float(bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1: the softmax of the most toxic word of each text; of none, that of the bias."""
        parts = [folded(t) for t in texts]
        joined = b"".join(parts)
        words, buckets, start = subwords(joined)
        n = len(start)
        z = np.full(len(texts), self.bias)
        if n:
            total, count = np.bincount(words, self.logits[buckets], n), np.bincount(words, minlength=n)
            own = self.bias + total / np.maximum(count, 1)
            text = np.searchsorted(np.cumsum([len(p) for p in parts]), start, side="right")
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            z[text[head]] = np.maximum.reduceat(own, head)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bag(text: str) -> list[bytes]:
    """The distinct words of a whole text, sorted."""
    return sorted(set(folded(text).split()))


def train(bags: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Train embeddings and softmax together, on the bags of whole texts."""
    if not bags or len(set(labels)) < 2:  # nothing to tell apart
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)) if bags else -2.0)
    # each distinct word once, with its n-grams; each document as its distinct words
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(w, len(number)) for words in bags for w in words], np.int32)
    docs = np.repeat(np.arange(len(bags), dtype=np.int32), [len(words) for words in bags])
    vocabulary, n_words = list(number), len(number)
    blocks, count = [], np.zeros(n_words, np.int32)
    for a in range(0, n_words, BLOCK):
        word, bucket, _ = subwords(b" " + b" ".join(vocabulary[a : a + BLOCK]) + b" ")
        blocks.append((a, word.astype(np.int32), bucket))
        count[a : a + BLOCK] = np.bincount(word, minlength=min(BLOCK, n_words - a))
    del number, vocabulary
    seen = np.zeros(BUCKETS, bool)
    for _, _, bucket in blocks:
        seen[bucket] = True
    used = np.flatnonzero(seen)
    place = np.cumsum(seen, dtype=np.int32) - 1
    blocks = [(a, word, place[bucket]) for a, word, bucket in blocks]
    share = 1.0 / np.maximum(count, 1)
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(used), WIDTH))
    out, bias = rng.normal(0, 0.3, WIDTH), -1.0
    g_emb, g_out, g_bias = np.full(len(used), 1e-8), np.full(WIDTH, 1e-8), 1e-8
    z = np.zeros(n_words)
    for epoch in range(epochs):
        logit = emb @ out
        for a, word, bucket in blocks:
            z[a : a + BLOCK] = np.bincount(word, logit[bucket], min(BLOCK, n_words - a))
        zd = (z * share + bias)[own]
        sharp = 1.0 + 4.0 * epoch / epochs  # from an average towards the strongest word
        e = np.exp(sharp * (zd - _per_doc_max(zd, docs, len(y))[docs]))
        a = e / np.bincount(docs, e, len(y))[docs]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(docs, a * zd, len(y)), -30, 30)))
        slope = ((p - y) * weight)[docs] * a
        by_word = np.bincount(own, slope, n_words) * share
        by_bucket = np.zeros(len(used))
        for first, word, bucket in blocks:
            by_bucket += np.bincount(bucket, by_word[first : first + BLOCK][word], len(used))
        d_out = emb.T @ by_bucket
        d_bias = slope.sum()
        # Adagrad; the gradient of an embedding is by_bucket times the softmax's direction
        g_emb += by_bucket**2 * (out @ out)
        emb -= 0.5 * (by_bucket / np.sqrt(g_emb))[:, None] * out
        g_out += d_out**2
        out -= 0.05 * d_out / np.sqrt(g_out)
        g_bias += d_bias**2
        bias -= 0.1 * d_bias / np.sqrt(g_bias)
    logits = np.zeros(BUCKETS)
    logits[used] = emb @ out
    return Model(logits, bias)


def _per_doc_max(z: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -1e9)
    head = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    out[docs[head]] = np.maximum.reduceat(z, head)
    return out


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on about `sample` documents of either label, taken by a hash of the id, of those with crc32(doc_id) mod 5 not 0."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {x["toxic"]: x["n"] for x in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    dealt = F.xxhash64("doc_id", F.lit(9)) / F.lit(2.0**64) + 0.5
    bound = F.when(F.col("toxic") == 1, sample / max(n.get(1, 1), 1)).otherwise(2 * sample / max(n.get(0, 1), 1))
    taken = marks.filter(dealt < bound)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken.select("doc_id")), "doc_id")  # 3 * sample ids, about

    def bags(batch: pa.RecordBatch):
        for part in common.slices(batch, "text", 1 << 19):
            words = [b" ".join(bag(t or "")) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(words, pa.binary())], names=["doc_id", "words"])

    # only the distinct words of the sample come to the driver
    rows = common.map_arrow(held, bags, "doc_id long, words binary").groupBy("doc_id").agg(F.min("words").alias("words")).join(F.broadcast(taken), "doc_id").orderBy("doc_id").collect()
    return train([bytes(x["words"]).split() for x in rows], [x["toxic"] for x in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text.

    Returns, for every row: doc_id, held_out, score, predicted (score >= 0.5).
    Empty and null texts get the score of the bias alone. Labels other than 0
    and 1 are left out; a document labelled twice is toxic if one label says so.
    Without labels of both kinds the score is one constant.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))  # BUCKETS numbers

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "text", 1 << 19):
            s = model.value.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text"), rows, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with all their columns, less those scored 0.5 or more."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def rows(batch: pa.RecordBatch):
        at = batch.schema.get_field_index("text")
        texts = pa.record_batch([batch.column(at)], names=["text"])
        keep = np.concatenate([model.value.scores([t or "" for t in part.column("text").to_pylist()]) < 0.5 for part in common.slices(texts, "text", 1 << 19)])
        return batch.filter(pa.array(keep))

    return common.map_arrow(docs, rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
