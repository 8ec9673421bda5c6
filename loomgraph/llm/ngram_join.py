"""N-gram Jaccard join (5): MinHash LSH forest.

Each document's set of word 5-grams has a MinHash signature, cut into TREES
labels of DEPTH values, the paths of as many prefix tries. A prefix of d values
is shared in some trie with probability 1 - (1 - t**d)**TREES at similarity t:
prefixes are shortened from DEPTH on until that reaches the target recall at
the threshold. Every two classes (documents of one set) of a node at that
prefix are candidates, verified on the texts: the members of a large node are
dealt into blocks, and each two blocks meet in one group of rows. A pair that
shares several nodes is verified in the one of the lowest tree only. What a
group yields is a count of links and an edge for each member, so no table holds
the pairs of a node unless the links themselves are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, seqhash
from .graph import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.999
#: Members of a block of a large node, and n-grams of its members: what bounds a task's memory, never what is compared.
BLOCK, GRAMS = 512, 1 << 20
_MULTIPLY = np.random.default_rng(5).integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Hashes of the distinct n-grams of words of text, sorted; a text of fewer words has one, all of them; one without words none."""
    v = seqhash.words(text)[2]
    if not len(v):
        return v
    return np.unique(seqhash.grams(v, min(n, len(v))))


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which the forest reaches the target recall at the threshold."""
    return next((d for d in range(deepest, 0, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set."""
    short = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 2**32 - 1, np.uint32)
    for a in range(0, len(short), 2048):
        h = short[a : a + 2048, None] * _MULTIPLY
        h ^= h >> np.uint32(15)
        least = np.minimum(least, h.min(axis=0))
    return least


def _signed(n: int, depth: int):
    def rows(batch: pa.RecordBatch):
        tree = seqhash.mix(np.arange(TREES, dtype=np.uint64) + np.uint64(77))
        for part in common.slices(batch, "_text"):
            out = []
            for text, i, key in zip(common.raw(part.column("_text")), part.column("_id").to_pylist(), part.column("_key").to_pylist(), strict=True):
                s = shingles(text, n)
                if not len(s):
                    continue
                label = signature(s).reshape(TREES, DEPTH).astype(np.uint64)
                nodes = tree
                for d in range(depth):
                    nodes = seqhash.mix(nodes * np.uint64(0x9E3779B97F4A7C15) + label[:, d])
                whole = seqhash.mix(np.array([np.sum(seqhash.mix(s)), np.sum(s * s | np.uint64(1)), len(s)], np.uint64))
                cls = int((whole[0] ^ (whole[2] << np.uint64(1))).view(np.int64))
                out.append((cls, int(whole[1].view(np.int64)), i, key, len(s), nodes.view(np.int64)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], names=["cls", "check", "_id", "_key", "size", "nodes"])

    return rows


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values sets[i] and sets[j] share, for each i of left and j of right; each set is sorted and distinct."""
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, row = np.unique(left, return_inverse=True)
    cols, col = np.unique(right, return_inverse=True)
    often = n > 1
    wide = int(often.sum())
    if 2.0 * len(rows) * len(cols) * wide > 1e5 * len(left):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    place = np.where(often, np.cumsum(often) - 1, -1)[at]
    ends = np.cumsum([len(x) for x in sets])
    own = [place[e - len(x) : e] for x, e in zip(sets, ends.tolist(), strict=True)]
    both = np.zeros((len(rows), len(cols)), np.int64)
    for first in range(0, wide, 4096):
        parts = []
        for which in (rows, cols):
            m = np.zeros((len(which), min(4096, wide - first)), np.float32)
            for k, i in enumerate(which.tolist()):
                x = own[i]
                m[k, x[(x >= first) & (x < first + 4096)] - first] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both[row, col]


def _linked(members: list[tuple], within: bool, tree: int, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links among members (cls, side, size, nodes, text) of a group: two arrays of places, and the similarities.

    All meet within a block, else those of one side meet those of the other;
    pairs that share a node of a lower tree are left to it.
    """
    side, size = (np.array([m[k] for m in members], np.int64) for k in (1, 2))
    nodes = np.array([m[3] for m in members], np.int64)
    a = np.flatnonzero(side == side.min())
    b = a if within else np.flatnonzero(side != side.min())
    x, y = size[a][:, None], size[b][None, :]
    meet = np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9
    if within:
        meet = np.triu(meet, 1)
    for k in range(tree):
        meet &= nodes[a, k][:, None] != nodes[b, k][None, :]
    i, j = np.nonzero(meet)
    if not len(i):
        return i, j, np.zeros(0)
    used, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    left, right = place[: len(i)], place[len(i) :]
    both = _shared([shingles(members[m][4], n) for m in used.tolist()], left, right)
    left, right = used[left], used[right]
    union = size[left] + size[right] - both
    keep = both >= threshold * union - 1e-9
    return left[keep], right[keep], (both / union)[keep]


def _joined(members: list[tuple], within: bool, tree: int, n: int, threshold: float, pairs: bool):
    """Rows of _verified for one group."""
    left, right, jaccard = _linked(members, within, tree, n, threshold)
    if not len(left):
        return None
    cls = np.array([m[0] for m in members], np.int64)
    if pairs:
        return np.maximum(cls[left], cls[right]), np.minimum(cls[left], cls[right]), jaccard
    count = np.bincount(np.concatenate([left, right]), minlength=len(cls))
    root = np.arange(len(cls))
    while True:
        to = root.copy()
        np.minimum.at(to, left, root[right])
        np.minimum.at(to, right, root[left])
        to = to[to]
        if (to == root).all():
            break
        root = to
    at = np.flatnonzero(count)
    return cls[at], cls[root[at]], count[at]


def _verified(n: int, threshold: float, pairs: bool):
    """Of rows in the order of (node, p, q): the links of each such group as a, b, jaccard, or else for each member with links itself, one member of those that the group's links join to it, and their number."""
    names = ["a", "b", "jaccard"] if pairs else ["cls", "root", "n"]
    kinds = [pa.int64(), pa.int64(), pa.float64() if pairs else pa.int64()]

    def rows(batches):
        key, tree, held, out, size = None, 0, [], [], 0

        def shown():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            text = common.raw(batch.column("_text"))
            cols = [batch.column(c).to_pylist() for c in ("node", "p", "q", "tree", "cls", "side", "size", "nodes")]
            for k, (node, p, q, t, cls, side, many, nodes) in enumerate(zip(*cols, strict=True)):
                if (node, p, q) != key:
                    if len(held) > 1 and (found := _joined(held, key[1] == key[2], tree, n, threshold, pairs)):
                        out.append(found)
                        size += len(found[0])
                        if size > 10_000:
                            yield shown()
                            out, size = [], 0
                    key, tree, held = (node, p, q), t, []
                held.append((cls, side, many, nodes, text[k]))
        if len(held) > 1 and (found := _joined(held, key[1] == key[2], tree, n, threshold, pairs)):
            out.append(found)
        if out:
            yield shown()

    return rows


def _candidates(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """A row for every keyed document (_id, _key, cls, n_copies), and the classes that meet: rows of groups (node, p, q), with what _verified needs."""
    docs = common.keyed(docs)
    depth = prefix_depth(threshold, recall=recall)
    signed = common.map_arrow(docs, _signed(n, depth), "cls long, check long, _id long, _key long, size long, nodes array<long>")
    signed = common.written(signed)
    # documents of one set by 128 bits of hashes; a class goes by its first document from here on
    own = F.when(F.col("at._key") == 0, F.col("at._id")).otherwise(F.xxhash64("at._id", "at._key"))
    classes = common.written(
        signed.groupBy("cls", "check")
        .agg(F.min(F.struct("_id", "_key")).alias("at"), F.count("*").alias("n_copies"), F.any_value("size").alias("size"), F.any_value("nodes").alias("nodes"))
        .select(F.col("cls").alias("h1"), F.col("check").alias("h2"), own.alias("cls"), "at.*", "n_copies", "size", "nodes")
    )
    placed = classes.select("cls", "size", F.posexplode("nodes").alias("tree", "node"))
    # nodes of the same members show the same pairs: the one of the lowest tree does
    ends = placed.groupBy("node").agg(
        F.min("tree").alias("tree"), F.count("*").alias("n"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")
    )
    kept = ends.filter("n > 1").groupBy("n", "grams", "x", "y").agg(F.min(F.struct("tree", "node")).alias("at"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / GRAMS)).cast("int")
    kept = kept.select("at.node", blocks.alias("blocks"))
    met = common.written(placed.join(kept.hint("shuffle_hash"), "node").select("node", "tree", "cls", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int").alias("side"), "blocks"))

    # only classes that share a node with another one can be linked, so only their texts are fetched
    wanted = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "_id", "_key", "size", "nodes")
    texts = common.written(docs.select("_id", "_key", "_text").join(wanted.hint("shuffle_hash"), ["_id", "_key"]).select("cls", "size", "nodes", "_text").dropDuplicates(["cls"]))
    each = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("node", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "tree", "cls", "side").join(texts, "cls")
    named = signed.select("_id", "_key", F.col("cls").alias("h1"), F.col("check").alias("h2")).distinct()
    members = docs.select("_id", "_key").join(named, ["_id", "_key"], "left").join(classes.select("h1", "h2", "cls", "n_copies"), ["h1", "h2"], "left")
    return members.select("_id", "_key", "cls", "n_copies"), each.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q")


def _counted(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members as of ngram_jaccard_join, the number of links of each class that has some (cls, n), and the candidates."""
    members, each = _candidates(docs, threshold, n, recall)
    found = common.written(each.mapInArrow(_verified(n, threshold, False), "cls long, root long, n long"))
    part = common.written(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    members = members.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("_id", "_key", "cls", "n_copies", "component")
    return members, found.groupBy("cls").agg(F.sum("n").alias("n")), each


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Links between documents whose sets of word n-grams have a Jaccard similarity of the threshold or more.

    Returns (members, links). members has a row for every keyed document: _id,
    _key, cls (its class, documents with the same set; null if it has no
    words), n_copies (of that class), component (class of the least document
    it is linked to, over any number of links; null if alone). links has all
    pairs of different classes that share a node and are as similar: a, b,
    jaccard; it is computed when read, and grows with the square of a group.
    What may be missing is what shares no node: at the threshold, 1 - recall
    of the links, and fewer the more similar. Texts without words are like no
    other.
    """
    members, _, each = _counted(docs, threshold, n, recall)
    return members, each.mapInArrow(_verified(n, threshold, True), "a long, b long, jaccard double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """A row for every row of docs: doc_id, class_id, n_links, and _id, _key, stays.

    class_id is the least doc_id of the documents that links join to this one,
    itself included. n_links counts its links, all verified: to the other rows
    of its own set, and to the classes found similar; 0 for a document like no
    other. stays marks the first document of each group, alone or not. A null
    doc_id is never a class_id unless all of the class are null.
    """
    members, ends, _ = _counted(docs, threshold, n, RECALL)
    members = common.written(members)
    group = F.coalesce("component", "cls")
    heads = members.filter("cls is not null").select(group.alias("g"), "_id", "_key").groupBy("g").agg(F.min(F.struct("_id", "_key")).alias("head"))
    out = members.withColumn("g", group).join(heads.hint("shuffle_hash"), "g", "left").join(ends.hint("shuffle_hash"), "cls", "left")
    stays = F.col("head").isNull() | ((F.col("head._id") == F.col("_id")) & (F.col("head._key") == F.col("_key")))
    out = out.select("_id", "_key", F.coalesce("head._id", "_id").alias("_head"), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("n_copies") - 1, F.lit(0))).alias("n_links"), stays.alias("stays"))
    return out.select(common.shown_id(), F.when(F.col("_head") != common.NULL_ID, F.col("_head")).alias("class_id"), "n_links", "_id", "_key", "stays")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """docs with all their columns, one document of each group of near duplicates; those alone, and those without words, all stay."""
    names = docs.columns
    near = near_duplicates(docs, threshold, n).filter("n_links > 0").select("_id", "_key", "stays").distinct()
    joined = common.rowed(docs).join(near.hint("shuffle_hash"), ["_id", "_key"], "left")
    alone = joined.filter("stays is null").select("_row", "_text")
    first = joined.filter("stays").dropDuplicates(["_id", "_key"]).select("_row", "_text")
    return alone.unionByName(first).select(*common.unrowed(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")
