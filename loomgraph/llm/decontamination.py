"""Benchmark decontamination (3): greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of MIN_TILE
tokens. A pair goes on if its seeds could cover the threshold of the item's
tokens; then the longest matches between the two texts that don't overlap are
marked again and again, found by running Karp-Rabin hashes of shrinking
lengths, and the item is held to be in the document if the marked tiles cover
the threshold of it, in whatever order they stand there.

Before the join a document's runs are looked up in a bitmap of all seeds, of a
fixed size; it only spares rows, as the join that follows is exact.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, seqhash

#: Tokens of the shortest tile; share of an item's tokens that tiles must cover.
MIN_TILE, COVERAGE = 5, 0.5
#: Bits of the seeds' bitmap, 1 MB whatever the benchmark's size, and of a part that an executor makes.
BITS, PAGE = 1 << 23, 1 << 13
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def token_hashes(text: bytes) -> np.ndarray:
    """Tokens are runs of letters and digits, A-Z lower-cased; punctuation and white space part them."""
    return seqhash.words(text.translate(_FOLD))[2]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles of greedy string tiling, each token of either side in one tile at most."""
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]
    sums = [seqhash.prefix(item), seqhash.prefix(doc)]
    tiles, s = [], max(shortest, 20)

    def windows(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and running hashes of the windows that hold free tokens only."""
        taken = np.r_[0, np.cumsum(~free[side])]
        n = len(free[side]) - size + 1
        at = np.flatnonzero(taken[size : size + n] == taken[:n]) if n > 0 else np.zeros(0, np.int64)
        return at, seqhash.span(sums[side], at, at + size)

    while True:
        (ia, ih), (da, dh) = windows(0, s), windows(1, s)
        by: dict[int, list[int]] = {}
        for p, h in zip(ia.tolist(), ih.tolist(), strict=True):
            by.setdefault(h, []).append(p)
        found: list[tuple[int, int, int]] = []
        longest = 0
        hit = np.isin(dh, ih)
        for q, h in zip(da[hit].tolist(), dh[hit].tolist(), strict=True):
            for p in by[h]:
                if p and q and free[0][p - 1] and free[1][q - 1] and item[p - 1] == doc[q - 1]:
                    continue  # part of the match that begins before
                n = 0
                while p + n < len(item) and q + n < len(doc) and free[0][p + n] and free[1][q + n] and item[p + n] == doc[q + n]:
                    n += 1
                if n >= s:
                    found.append((n, p, q))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        heap = [(-n, p, q) for n, p, q in found]
        heapify(heap)
        while heap:  # the longest first, then the first in the item and in the document
            n, p, q = heappop(heap)
            ok = free[0][p : p - n] & free[1][q : q - n]
            if ok.all():
                free[0][p : p - n] = free[1][q : q - n] = False
                tiles.append((p, q, -n))
            else:  # what is left of it on either side may still be a tile
                edges = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if b - a >= s:
                        heappush(heap, (a - b, p + a, q + a))
        if s == shortest:
            return sorted(tiles)
        s = max(shortest, s // 2)


def _seeds(v: np.ndarray, shortest: int) -> np.ndarray:
    """Hashes of the runs of `shortest` tokens of v; of fewer tokens, that of all of them."""
    return seqhash.grams(v, min(shortest, len(v))) if len(v) else v


def _seed_rows(shortest: int):
    def rows(batch: pa.RecordBatch):
        out = []
        for text, i in zip(common.raw(batch.column("text")), batch.column("item_id").to_pylist(), strict=True):
            v = token_hashes(text)
            for p, h in enumerate(_seeds(v, shortest).view(np.int64).tolist()):
                out.append((h, i, p, len(v)))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h", "item_id", "p", "n"])

    return rows


def _page_rows(batch: pa.RecordBatch):
    bits = []
    for slots in batch.column("slots").to_pylist():
        own = np.zeros(PAGE, np.uint8)
        own[slots] = 1
        bits.append(np.packbits(own, bitorder="little").tobytes())
    yield pa.record_batch([batch.column("page"), pa.array(bits, pa.binary())], names=["page", "bits"])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) & np.uint64(BITS - 1)).astype(np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of keyed docs and items of the benchmark whose tiles cover `coverage` of the item: _id, _key, item_id, coverage, n_tiles.

    An item of fewer than `shortest` tokens, a run that stands in clean texts
    too, is held by documents that are that item and nothing else. Items and
    documents without tokens, and null texts, hold nothing; null item_ids are
    left out; of rows that share an item_id each text is tested and the best
    counts.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    seeds = common.written(common.map_arrow(items, _seed_rows(shortest), "h long, item_id long, p long, n long"))
    slots = seeds.select(F.col("h").bitwiseAND(F.lit(BITS - 1)).alias("slot")).distinct()
    pages = common.map_arrow(slots.groupBy(F.expr(f"cast(slot div {PAGE} as int)").alias("page")).agg(F.collect_list(F.expr(f"cast(slot % {PAGE} as int)")).alias("slots")), _page_rows, "page int, bits binary")
    bitmap = np.zeros(BITS // 8, np.uint8)
    for page, bits in pages.collect():  # BITS / PAGE rows of PAGE / 8 bytes at most
        bitmap[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bits, np.uint8)
    held = spark.sparkContext.broadcast(bitmap.tobytes())

    def rows(batch: pa.RecordBatch):
        bits = np.frombuffer(held.value, np.uint8)
        for part in common.slices(batch, "_text"):
            hs, n = [], []
            for i, text in enumerate(common.raw(part.column("_text"))):
                h = _seeds(token_hashes(text), shortest)
                slot = _slot(h)
                h = np.unique(h[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1])
                hs.append(h)
                n.append(np.full(len(h), i))
            hs, n = np.concatenate(hs), np.concatenate(n)
            if len(hs):
                yield pa.record_batch([pa.array(hs.view(np.int64)), part.column("_id").take(pa.array(n)), part.column("_key").take(pa.array(n))], names=["h", "_id", "_key"])

    met = common.map_arrow(docs.select("_id", "_key", "_text"), rows, "h long, _id long, _key long").distinct().join(seeds.hint("shuffle_hash"), "h")
    reach = F.size(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + (shortest - 1))))))
    pairs = met.groupBy("_id", "_key", "item_id").agg(F.collect_set("p").alias("ps"), F.min("n").alias("n")).filter(reach >= F.col("n") * F.lit(coverage)).select("_id", "_key", "item_id")
    listed = pairs.join(items, "item_id").groupBy("_id", "_key").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def tile(batch: pa.RecordBatch):
        out = []
        known: dict[str, np.ndarray] = {}
        for text, i, key, tests in zip(common.raw(batch.column("_text")), batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("items").to_pylist(), strict=True):
            v = token_hashes(text)
            best: dict[int, tuple] = {}
            for x in tests:
                if len(known) > 1000:
                    known.clear()
                item = known.setdefault(x["text"], token_hashes(x["text"].encode()))
                if len(item) < shortest:
                    tiles = [(0, 0, len(item))] if np.array_equal(item, v) else []
                else:
                    tiles = greedy_tiles(item, v, shortest)
                best[x["item_id"]] = max(best.get(x["item_id"], (0.0, 0)), (sum(t[2] for t in tiles) / len(item), len(tiles)))
            out += [(i, key, item, *found) for item, found in best.items() if found[0] >= coverage]
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64())], names=["_id", "_key", "item_id", "coverage", "n_tiles"])

    suspects = docs.select("_id", "_key", "_text").join(listed.hint("shuffle_hash"), ["_id", "_key"]).select("_id", "_key", "_text", "items")
    return common.map_arrow(suspects, tile, "_id long, _key long, item_id long, coverage double, n_tiles long").dropDuplicates(["_id", "_key", "item_id"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, shortest: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """A row for every row of docs: doc_id, contaminated, coverage (the most of any item; 0 if below the threshold), item_ids (sorted), and _id, _key."""
    docs = common.keyed(docs)
    found = contaminated(docs, benchmark, shortest, coverage).groupBy("_id", "_key").agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select("_id", "_key").join(found.hint("shuffle_hash"), ["_id", "_key"], "left")
    return out.select(common.shown_id(), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "_id", "_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """docs with all their columns, less those that hold an item of the benchmark."""
    base = common.rowed(docs)
    found = contaminated(base, benchmark, shortest, coverage).select("_id", "_key").distinct()
    return base.join(found, ["_id", "_key"], "left_anti").select(*common.unrowed(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "coverage", "item_ids")
