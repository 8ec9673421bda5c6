"""Where a document repeats, over a length, what stands in an earlier document.

Both substring operators come here: one with words as tokens, one with bytes.
The work is linear in the corpus; at no point are pairs of a group made.

1. Anchors. Of each run of LENGTH tokens the least k-gram is selected
   (winnowing), so that two equal runs hold an equal anchor at an equal offset.
2. Seeds. Anchors are grouped by hash, combined before the shuffle; those that
   occur in one document only go. The rest are joined back to their
   occurrences (AQE splits what is hot there: the grouped side has one row a hash).
3. Classes. Occurrences whose whole context (all runs that hold the anchor) is
   equal form a class. All but the first document of a class repeat that
   context, however many they are. Most anchors have one class, which the
   grouping of step 2 tells already.
4. Extension. What is left is one context a class, for anchors with several
   classes. These are extended both ways against each other (extend()).
5. Spans go back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, seqhash

U = np.uint64
#: Classes of one anchor that a task extends against each other in memory; those of a larger group are compared by a grouping of their runs' hashes.
GROUP = 30_000
_SHIFT = 1 << 20
#: 48 bits of a hash do: anchors that share one by chance have other contexts, and a class is named by both hashes.
_MOST = U((1 << 48) - 1)


@dataclass(frozen=True)
class Tokens:
    """What a text is a sequence of. length: tokens of a repeat; k: tokens of an anchor."""

    kind: str
    k: int
    length: int

    @property
    def side(self) -> int:
        return self.length - self.k

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a column of texts one after another, as they are compared in an extension, and where each text's begin (and the last one's end)."""
        if self.kind == "bytes":
            return common.flat(column)
        held = [seqhash.words(text)[2] for text in common.raw(column)]
        return np.concatenate([np.zeros(0, np.uint64), *held]), np.cumsum([0, *map(len, held)])

    def hashes(self, v: np.ndarray) -> np.ndarray:
        """64 bits of each token."""
        return v if self.kind == "words" else seqhash.BYTE[v]

    @property
    def dtype(self):
        return np.dtype(np.uint64 if self.kind == "words" else np.uint8)


def _anchor_rows(tokens: Tokens, placed: bool):
    """h, c, _id of each anchor: hashes of itself and of its context; placed: also _key and p, where it stands."""

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "_text", 1 << 18):
            v, at = tokens.of(part.column("_text"))
            v = tokens.hashes(v)
            p = seqhash.minimizers(v, at[1:], tokens.k, tokens.length)
            if not len(p):
                continue
            i = np.searchsorted(at, p, "right") - 1
            sums = seqhash.prefix(v)
            h = seqhash.span(sums, p, p + tokens.k) & _MOST
            c = seqhash.span(sums, np.maximum(p - tokens.side, at[i]), np.minimum(p + tokens.length, at[i + 1])) & _MOST
            ids = part.column("_id").to_numpy(zero_copy_only=False)[i]
            if placed:
                keys = part.column("_key").to_numpy(zero_copy_only=False)[i]
                yield pa.record_batch([h.view(np.int64), c.view(np.int64), ids, keys, p - at[i]], names=["h", "c", "_id", "_key", "p"])
            else:
                yield pa.record_batch([h.view(np.int64), c.view(np.int64), ids], names=["h", "c", "_id"])

    return rows


def _context_rows(tokens: Tokens):
    """The contexts of the anchors listed for a document."""

    def rows(batch: pa.RecordBatch):
        for part in common.slices(batch, "_text"):
            v, starts = tokens.of(part.column("_text"))
            listed = part.column("at")
            doc = np.repeat(np.arange(len(part)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            h, ps, hot = listed.flatten().flatten()
            places, first = common.flat(ps)
            p = np.minimum.reduceat(places, first[:-1])
            a, b = np.maximum(p - tokens.side, 0), np.minimum(p + tokens.length, np.diff(starts)[doc])
            ids, keys = (part.column(x).to_numpy(zero_copy_only=False)[doc] for x in ("_id", "_key"))
            for x in range(0, len(p), 5000):
                y = slice(x, x + 5000)
                context = v[seqhash.spread(starts[doc[y]] + a[y], b[y] - a[y])]
                ends = np.r_[0, np.cumsum(b[y] - a[y])] * tokens.dtype.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        h[y], ids[y], keys[y], ps[y], pa.array((p - a)[y].astype(np.int32)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(context)]), hot[y],
                    ],
                    names=["h", "_id", "_key", "ps", "left", "context", "hot"],
                )

    return rows


def _common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b, which hold la and lb tokens."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, np.minimum(la, lb))


def _order(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Order of rows by group, then by the bytes of side."""
    rows = np.ascontiguousarray(np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), side.view(np.uint8).reshape(len(side), -1)], axis=1))
    return np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of a suffix array, by one scan with a stack.

    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is ignored.
    """
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        first = i - 1
        while now < stack[-1][0]:
            depth, first = stack.pop()
            out.append((depth, first, i - 1))
        if now > stack[-1][0]:
            stack.append((now, first))
    return out


def repeated_runs(group: np.ndarray, ids: np.ndarray, left: np.ndarray, nleft: np.ndarray, right: np.ndarray, nright: np.ndarray, k: int, length: int) -> np.ndarray:
    """For contexts that share an anchor: which runs of `length` tokens round it also stand in the context of a smaller id of the group.

    right has the tokens from the anchor's start on, left those before it, the
    nearest first. Both are sorted into suffix arrays with their common
    prefixes. The interval of depth r of the right array and that of depth
    length - r of the left one, met in an element, hold just the elements that
    share the run with r tokens from the anchor's start on. Returned: an array
    of elements by length - k + 1 booleans, for r from k on.
    """
    n = len(ids)
    at, most = [], []
    for side, size in ((right, nright), (left, nleft)):
        order = _order(group, side)
        lcp = np.zeros(n, np.int64)
        if n > 1:
            lcp[1:] = _common(side[order[1:]], side[order[:-1]], size[order[1:]], size[order[:-1]])
            lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
        lcp[0] = -1
        at.append((order, lcp))
        # the deepest interval of two or more that an element is in
        deepest = np.empty(n, np.int64)
        deepest[order] = np.maximum(lcp, np.r_[lcp[1:], -1])
        most.append(deepest)
    found = np.zeros((n, length - k + 1), bool)
    runs = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for r in range(k, length + 1):
        some = np.flatnonzero((most[0] >= r) & (most[1] >= length - r))
        if not len(some):
            continue
        for run, (order, lcp), depth in zip(runs, at, (r, length - r), strict=True):
            run[order] = np.cumsum(lcp < depth)
        pair = runs[0][some] * (n + 1) + runs[1][some]
        order = np.argsort(pair, kind="stable")
        head = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
        own = ids[some[order]]
        first = np.minimum.reduceat(own, head)
        found[some[order], r - k] = own > np.repeat(first, np.diff(np.r_[head, len(some)]))
    return found


def _extend_rows(tokens: Tokens):
    """Sorted by h: (_id, _key, start, end) of the runs that contexts share with those of smaller ids."""
    side, length, k = tokens.side, tokens.length, tokens.k

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        h = rows.column("h").to_numpy()
        group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
        ids, n = rows.column("_id").to_numpy(), len(h)
        nleft = rows.column("left").to_numpy().astype(np.int64)
        left, right = np.zeros((n, max(side, 1)), tokens.dtype), np.zeros((n, length), tokens.dtype)
        v, at = common.flat(rows.column("context").combine_chunks())
        v, at = v.view(tokens.dtype), at // tokens.dtype.itemsize
        nright = np.diff(at) - nleft
        own = np.repeat(np.arange(n), np.diff(at))
        far = np.arange(len(v)) - np.repeat(at[:-1] + nleft, np.diff(at))
        before = far < 0
        left[own[before], -1 - far[before]] = v[before]
        right[own[~before], far[~before]] = v[~before]
        found = repeated_runs(group, ids, left, nleft, right, nright, k, length)
        which, r = np.nonzero(found)
        if not len(which):
            return None
        # runs that touch are one span: r falls as the start moves right, so neighbours differ by one
        head = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (r[1:] != r[:-1] + 1)])
        last = np.r_[head[1:], len(which)] - 1
        el, r0, r1 = which[head], r[head] + k, r[last] + k
        flat, offsets = common.flat(rows.column("ps").combine_chunks())
        times = np.diff(offsets)[el]
        pos = flat[seqhash.spread(offsets[el], times)]
        rep = lambda x: np.repeat(x, times)
        keys = rows.column("_key").to_numpy()
        return pa.record_batch([rep(ids[el]), rep(keys[el]), pos + rep(r0 - length), pos + rep(r1)], names=["_id", "_key", "a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                if (out := solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))) is not None:
                    yield out
                held = []
            elif held and held[-1].column("h")[-1].as_py() != h[0]:
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            held.append(batch.slice(cut))
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _run_rows(tokens: Tokens):
    """For anchors with very many classes: two hashes of each run of a context, to be grouped."""
    side, length, k = tokens.side, tokens.length, tokens.k

    def rows(batch: pa.RecordBatch):
        out = []
        hs = batch.column("h").to_numpy()
        for i, (x, m) in enumerate(zip(batch.column("context").to_pylist(), batch.column("left").to_pylist(), strict=True)):
            v = np.frombuffer(x, tokens.dtype)
            v = tokens.hashes(v)
            starts = np.arange(max(0, m + k - length), min(m, len(v) - length) + 1)
            if len(starts):
                one = seqhash.span(seqhash.prefix(v), starts, starts + length)
                two = seqhash.span(seqhash.prefix(seqhash.mix(v)), starts, starts + length)
                tag = seqhash.mix(hs[i : i + 1].view(np.uint64))
                out.append((one ^ tag, two, starts - m, np.full(len(starts), i)))
        if out:
            one, two, off, i = map(np.concatenate, zip(*out, strict=True))
            pick = pa.array(i)
            yield pa.record_batch([one.view(np.int64), two.view(np.int64), batch.column("_id").take(pick), batch.column("_key").take(pick), batch.column("ps").take(pick), pa.array(off)], names=["w1", "w2", "_id", "_key", "ps", "off"])

    return rows


def repeated_spans(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """_id, _key, spans of keyed docs: array of start * 2**32 + end, in tokens, of what repeats an earlier document; documents without any are left out.

    Starts are shifted by 2**20 (they may be below 0) and ends may lie beyond
    the text: mask() clips them.
    """
    spark = docs.sparkSession
    length, side = tokens.length, tokens.side
    text = docs.select("_id", "_key", "_text")

    anchors = common.map_arrow(text, _anchor_rows(tokens, False), "h long, c long, _id long")
    seeds = anchors.groupBy("h").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    seeds = common.written(seeds.filter("first < last").select("h", F.col("first").alias("f"), (F.col("c0") == F.col("c1")).alias("single")))

    anchors = common.map_arrow(text, _anchor_rows(tokens, True), "h long, c long, _id long, _key long, p long")
    met = anchors.join(seeds.hint("shuffle_hash"), "h").filter("not single or _id > f")
    many = ~F.col("single")
    met = common.written(met.select(F.when(many, F.col("h")).alias("h"), F.when(many, F.col("c")).alias("c"), "_id", "_key", "p", "single"), by="single", beside=2)
    common.discard(seeds)

    shared = met.filter("not single").select("h", "c", "_id", "_key", "p")
    classes = common.written(shared.groupBy("h", "c").agg(F.min("_id").alias("first")))
    groups = classes.groupBy("h").agg(F.count("*").alias("n"))
    classes = classes.join(groups.hint("shuffle_hash"), "h")
    placed = common.written(
        shared.join(classes.hint("shuffle_hash"), ["h", "c"])
        .select("h", "c", "_id", "_key", "p", (F.col("_id") > F.col("first")).alias("whole"), (F.col("n") > GROUP).alias("hot"))
    )

    again = met.filter("single").select("_id", "_key", "p").unionByName(placed.filter("whole").select("_id", "_key", "p"))
    whole = again.select("_id", "_key", (F.col("p") - side).alias("a"), (F.col("p") + length).alias("b"))
    listed = (
        placed.filter("not whole").groupBy("_id", "_key", "h", "c").agg(F.collect_list("p").alias("ps"), F.first("hot").alias("hot"))
        .groupBy("_id", "_key").agg(F.collect_list(F.struct("h", "ps", "hot")).alias("at"))
    )
    contexts = common.written(
        common.map_arrow(
            text.join(listed.hint("shuffle_hash"), ["_id", "_key"]).select("_id", "_key", "_text", "at"),
            _context_rows(tokens),
            "h long, _id long, _key long, ps array<long>, left int, context binary, hot boolean",
        )
    )
    extended = (
        contexts.filter("not hot").drop("hot").repartition(common.partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_extend_rows(tokens), "_id long, _key long, a long, b long")
    )
    runs = common.map_arrow(contexts.filter("hot").drop("hot"), _run_rows(tokens), "w1 long, w2 long, _id long, _key long, ps array<long>, off long")
    least = runs.groupBy("w1", "w2").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).filter("first < last")
    large = (
        runs.join(least.hint("shuffle_hash"), ["w1", "w2"]).filter("_id > first")
        .select("_id", "_key", F.explode("ps").alias("p"), "off")
        .select("_id", "_key", (F.col("p") + F.col("off")).alias("a"), (F.col("p") + F.col("off") + length).alias("b"))
    )
    spans = whole.unionByName(extended).unionByName(large)
    return common.written(
        spans.select("_id", "_key", (F.shiftleft(F.col("a") + _SHIFT, 32) + F.col("b")).alias("s")).groupBy("_id", "_key").agg(F.collect_set("s").alias("spans"))
    )


def mask(spans: list[int] | np.ndarray | None, n: int, length: int) -> np.ndarray:
    """Which of n tokens the spans of repeated_spans() cover."""
    edges = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        s = np.asarray(spans, np.int64)
        a, b = np.maximum((s >> 32) - _SHIFT, 0), np.minimum(s & 0xFFFFFFFF, n)
        whole = b - a >= length
        np.add.at(edges, a[whole], 1)
        np.add.at(edges, b[whole], -1)
    return np.cumsum(edges[:-1]) > 0
