"""BPE encoding and decoding (8): tree concatenation.

A text falls into units where the vocabulary's own splitting pattern always
cuts; a unit's ids don't depend on what stands round it, so a distinct one is
encoded once while a bounded table keeps it. A long stretch without such a cut
is split by the tokenizer's pre-tokenizer, and a long pre-token (one run of
letters, say) is encoded as a tree: its pieces apart, then joined in pairs,
each join mended by re-encoding a growing window round it until the window's
ends agree with both sides.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, seqhash

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a unit above which it is split further; characters of a leaf of the tree.
LONG, LEAF = 2000, 512
#: Units that each of a worker's two tables keeps, and characters of those kept.
KEPT, KEPT_LEN = 100_000, 48
#: Units that the table of arrays() keeps, 80 bytes or so each, before it starts again.
HASHED = 1_000_000
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: In a text without what _HARD finds, each match of _UNIT can be encoded apart: runs of letters, with the blank before, and what stands between them.
_UNIT = re.compile(f" ?[{_LETTER}]+|(?:[^{_LETTER} ]+| (?![{_LETTER}]))+")
_HARD = r"\s\s|'|[^\x00-\xff]"
#: The same sets by code point, for whole arrays of text; characters of a segment.
_WHITE = np.array([chr(c).isspace() for c in range(1 << 16)])
_IS_LETTER = np.array([bool(re.match(f"[{_LETTER}]", chr(c))) for c in range(256)])
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def concatenate(left: list[int], right: list[int], spell, encode, window: int = 8) -> list[int]:
    """Ids of a text from those of its two parts.

    spell gives the text of some ids, encode the ids of a text. The last ids of
    left and the first of right are spelled and encoded again. If the new ids
    begin with the window's first id and end with its last, each id has the
    neighbours it needs: every two adjacent ids have then come out side by side
    of one encoding, which makes a BPE sequence the one of its whole text.
    Otherwise the window grows; at most it is all of both parts.
    """
    while True:
        a, b = left[-window:], right[:window]
        again = encode(spell(a + b))
        whole_left, whole_right = window >= len(left), window >= len(right)
        if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]) and (len(again) > 1 or whole_left or whole_right):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        window *= 2


def tree_encode(text: str, spell, encode, encode_many, leaf: int = LEAF) -> list[int]:
    """Ids of an unsplit text: leaves are encoded together, and in parallel where the library may, then joined in pairs."""
    level = encode_many([text[i : i + leaf] for i in range(0, len(text), leaf)])
    while len(level) > 1:
        level = [concatenate(level[i], level[i + 1], spell, encode) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Codec:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE vocabulary, add_special_tokens=False, no truncation, no padding."""

    def __init__(self, path: str, shown: bool = False, long: int = LONG, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.shown, self.long, self.leaf = shown, long, leaf
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(model | {"truncation": None, "padding": None}))
        self.added = [x["content"] for x in model["added_tokens"]]
        self.blank_splits = not any(" " in x for x in self.added)
        self.hard = re.compile("|".join([_HARD, *map(re.escape, self.added)]))
        #: The merges alone, for a pre-token or a part of one, spelled in the vocabulary's characters.
        self.merges = Tokenizer.from_str(json.dumps(model | {"truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": None, "decoder": None, "post_processor": None}))
        self.names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.units: dict = {}
        self.older: dict = {}
        self._forget()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        size = max(self.names) + 1
        #: What an id decodes to, as bytes, and as a decimal with a comma.
        self.spelled = [self._plain(self.names.get(i, "")) for i in range(size)]
        self.decimal = [f"{i},".encode() for i in range(size)]
        self.lengths = np.array([len(x) for x in self.spelled])
        self.places = np.array([len(x) for x in self.decimal])

    def _spell(self, ids: list[int]) -> str:
        return "".join(self.names[i] for i in ids)

    def _merge(self, text: str) -> list[int]:
        return self.merges.encode(text, add_special_tokens=False).ids

    def _long_unit(self, text: str) -> list[int]:
        """Ids of a long unit: by its pre-tokens, the long ones as trees."""
        out: list[int] = []
        parts = [text]
        for special in self.added:  # matched before anything else
            parts = [y for x in parts for y in ([x] if x in self.added else _around(x, special))]
        for part in parts:
            if part in self.added:
                out.append(self.tokenizer.token_to_id(part))
                continue
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            short = [p for p in pieces if len(p) <= self.leaf]
            ids = iter(self.merges.encode_batch(short, add_special_tokens=False))
            many = lambda xs: [e.ids for e in self.merges.encode_batch(xs, add_special_tokens=False)]
            for p in pieces:
                out += next(ids).ids if len(p) <= self.leaf else tree_encode(p, self._spell, self._merge, many, self.leaf)
        return out

    def _plain(self, name: str) -> bytes:
        return bytes(self.byte[c] for c in name) if all(c in self.byte for c in name) else name.encode()

    def _bytes(self, ids: list[int]) -> bytes:
        """What ids decode to, as bytes: the library's decoder joins them before it reads UTF-8."""
        return b"".join([self.spelled[i] for i in ids])

    def _enter(self, lot: list[str], ids: list[int]) -> None:
        """Keep the entries of units whose ids follow each other in ids: ids as unsigned 32-bit little-endian or, for shown, as decimals with commas, and decoded bytes."""
        packed = np.array(ids, "<u4")
        ends = np.cumsum(self.lengths[packed])
        cuts = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in lot])) + 1
        if self.shown:
            decimal, plain = b"".join([self.decimal[i] for i in ids]), self._bytes(ids)
            to = [0, *np.cumsum(self.places[packed])[cuts - 1].tolist()]
            at = [0, *ends[cuts - 1].tolist()]
            self.units.update(zip(lot, [(decimal[a:b], plain[c:d]) for a, b, c, d in zip(to, to[1:], at, at[1:], strict=False)], strict=True))
        else:
            whole, to = packed.tobytes(), [0, *(4 * cuts).tolist()]
            self.units.update(zip(lot, [whole[a:b] for a, b in zip(to, to[1:], strict=False)], strict=True))

    def _learn(self, missing: list[str]) -> None:
        """Encode units that neither table has. Words with a blank before them go in strings of a hundred, as the splitting cuts before each blank."""
        strung, single = [], []
        for u in missing:
            if len(u) > self.long:
                self._enter([u], self._long_unit(u))
            else:
                (strung if u[0] == " " and u[1:].isalpha() else single).append(u)
        for u, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            self._enter([u], e.ids)
        lots = [strung[i : i + 100] for i in range(0, len(strung), 100)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast(["".join(x) for x in lots], add_special_tokens=False), strict=True):
            self._enter(lot, e.ids)

    def _pieces(self, text: str) -> list[str]:
        """Units of text: cut before each blank that stands between two characters that aren't white space, and, where that is safe, round each run of letters."""
        if not self.hard.search(text):
            return _UNIT.findall(text)
        if not self.blank_splits:
            return [text]
        out: list[str] = []
        held = ""
        for n, p in enumerate(text.split(" ")):
            if n and p and not p[0].isspace() and held and not held[-1].isspace():
                out.append(held)
                held = f" {p}"
            else:
                held += f" {p}" if n else p
        units = []
        for u in [*out, held]:
            units += [u] if self.hard.search(u) else _UNIT.findall(u)
        return units

    def encode_many(self, texts: list[str]) -> list[list]:
        """For each text the entries of its units; see _enter()."""
        if len(self.units) > KEPT:
            self.older, self.units = self.units, {}
        get, split, found = self.units.get, [], []
        missing: dict[str, None] = {}
        for text in texts:
            units = self._pieces(text) if text else []
            entries = list(map(get, units))
            if None in entries:
                for u, e in zip(units, entries, strict=True):
                    if e is None and u not in missing:
                        old = self.older.get(u)
                        if old is None:
                            missing[u] = None
                        else:
                            self.units[u] = old
                split.append((len(found), units))
            found.append(entries)
        if missing:
            self._learn(list(missing))
        for n, units in split:
            found[n] = list(map(get, units))
        for u in missing:
            if len(u) > KEPT_LEN:
                del self.units[u]
        return found

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit; of a codec that isn't shown. Units are cut and looked up as arrays, by a 64-bit hash, and compared by their characters."""
        segments, owner, out = [], [], [[] for _ in texts]
        for n, text in enumerate(texts):
            if not text:
                continue
            if not self.blank_splits or any(x in text for x in self.added):
                out[n].append(np.frombuffer(self.packed(text), "<u4"))
                continue
            for part in _segments(text):
                segments.append(part)
                owner.append(n)
        at, size = 0, 0
        for end, part in enumerate(segments, 1):
            size += len(part)
            if size >= SEGMENT or end == len(segments):
                for n, ids in zip(owner[at:end], self._lookup(segments[at:end]), strict=True):
                    out[n].append(ids)
                at, size = end, 0
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def _forget(self) -> None:
        """Empty the table of arrays(): sorted hashes of units; for each its spelling, where its ids stand in the pool, how many they are, and where its characters stand if it is long."""
        self.keys, self.place, self.spelled_units = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64), np.zeros((0, 3), np.uint64)
        self.pool, self.letters = _Pool(), _Pool()

    def _encoded_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units after one another, and the number of each unit's."""
        strung, single, long = [], [], []
        for n, u in enumerate(units):
            (long if len(u) > self.long else strung if u[0] == " " and u[1:].isalpha() else single).append(n)
        order = strung + single
        texts = ["".join([units[n] for n in strung[i : i + 100]]) for i in range(0, len(strung), 100)] + [units[n] for n in single]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32)
        # an id never spans two units, so their ends in bytes tell them apart
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(units[n].encode()) for n in order])) + 1
        count = np.zeros(len(units), np.int64)
        count[order] = np.diff(ends, prepend=0)
        parts = [ids]
        for n in long:
            parts.append(np.array(self._long_unit(units[n]), np.uint32))
            count[n] = len(parts[-1])
        order += long
        # from the order of encoding to that of units
        size = count[order]
        source = np.zeros(len(units), np.int64)
        source[order] = np.cumsum(size) - size
        whole = np.concatenate(parts)
        return whole[np.arange(count.sum()) + np.repeat(source - np.cumsum(count) + count, count)], count

    def _lookup(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part, none empty."""
        joined = "\n" + "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in parts])
        begins = np.cumsum(sizes + 1) - sizes
        forced = np.zeros(len(points), bool)
        forced[begins] = forced[begins - 1] = forced[-1] = True
        low = np.minimum(points, 0xFFFF)
        white, blank = _WHITE[low], points == 32
        letter = _IS_LETTER[np.minimum(points, 255)] & (points < 256)
        # pieces: from each blank between two characters that aren't white space
        cut = forced.copy()
        cut[1:-1] |= blank[1:-1] & ~white[:-2] & ~white[2:]
        hard = (points == 39) | (points > 255)
        hard[:-1] |= white[:-1] & white[1:]
        heads = np.flatnonzero(cut)
        soft = np.repeat(~np.logical_or.reduceat(hard, heads), np.diff(np.append(heads, len(points))))
        # units of the other pieces: round each run of letters, with the blank before it
        edge = np.zeros(len(points), bool)
        edge[1:] = (letter[1:] & ~letter[:-1] & ~blank[:-1]) | (~letter[1:] & letter[:-1])
        edge[:-1] |= blank[:-1] & letter[1:]
        starts = np.flatnonzero(cut | (edge & soft))
        ends = np.append(starts[1:], len(points))
        own = np.ones(len(points), bool)
        own[begins - 1] = own[-1] = False
        kept = own[starts]
        starts, ends = starts[kept], ends[kept]
        size = ends - starts
        spelled, long, far = _spellings(points, starts, size)
        found, first, which = np.unique(seqhash.mix(spelled[:, 0] * np.uint64(0x9E3779B97F4A7C15) + seqhash.mix(spelled[:, 1] + spelled[:, 2])), return_index=True, return_inverse=True)

        if len(self.keys) > HASHED or self.pool.size > 4 * HASHED:
            self._forget()
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        new = self.keys[at] != found if len(self.keys) else np.ones(len(found), bool)
        known = ~new
        # a hash only finds a unit; what it found is spelled alike, or all goes by the units' texts
        same = (spelled[first][which] == spelled).all()
        if same and len(far):
            own = np.cumsum(long) - 1
            begun = np.cumsum(size[long]) - size[long]
            same = (far == far[_spread(begun[own[first[which[long]]]], size[long])]).all()
        if same and known.any():
            mine, kept = first[known], self.place[at[known]]
            same = (self.spelled_units[at[known]] == spelled[mine]).all()
            if same and long[mine].any():
                mine, kept = mine[long[mine]], kept[long[mine]]
                same = (self.letters.held[_spread(kept[:, 2], size[mine])] == far[_spread(begun[own[mine]], size[mine])]).all()
        if not same:
            return [np.frombuffer(self.packed(x), "<u4") for x in parts]
        if new.any():
            units = [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids, count = self._encoded_units(units)
            mine = first[new]
            held = np.where(long[mine], size[mine], 0)
            put, written = self.pool.add(ids), self.letters.add(points[_spread(starts[mine][long[mine]], size[mine][long[mine]])])
            into = np.searchsorted(self.keys, found[new])
            self.keys = np.insert(self.keys, into, found[new])
            self.spelled_units = np.insert(self.spelled_units, into, spelled[mine], axis=0)
            self.place = np.insert(self.place, into, np.column_stack([put + np.cumsum(count) - count, count, written + np.cumsum(held) - held]), axis=0)
            at = np.searchsorted(self.keys, found)
        place = self.place[at]
        count = place[which, 1]
        after = np.cumsum(count)
        ids = self.pool.held[_spread(place[which, 0], count)]
        bounds = np.append(0, after)[np.append(np.searchsorted(starts, begins), len(starts))]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def packed(self, text: str) -> bytes:
        """Ids of text as unsigned 32-bit little-endian values; of a codec that isn't shown."""
        return b"".join(self.encode_many([text])[0])

    def encode(self, text: str) -> list[int]:
        if self.shown:
            return [int(x) for x in b"".join([x[0] for x in self.encode_many([text])[0]]).split(b",")[:-1]]
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids).decode("utf-8", "replace")


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _spellings(points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three values for each unit, which ones are long, and the characters of those.

    Up to 16 characters below 256 are packed into two of the values and name a
    unit. Of longer units, and of others, one is a hash. The third is the size,
    and whether it is a hash.
    """
    wide = np.concatenate([[0], np.cumsum(points > 255)])
    long = (size > 16) | (wide[starts + size] > wide[starts])
    bytes_ = np.zeros(len(points) + 24, np.uint8)
    bytes_[: len(points)] = points  # truncated where wide, which those units don't use
    eight = np.ndarray((len(points) + 16,), "<u8", bytes_, strides=(1,))
    out = np.empty((len(starts), 3), np.uint64)
    out[:, 0] = eight[starts] & _LOW[np.minimum(size, 8)]
    out[:, 1] = eight[np.minimum(starts + 8, len(points))] & _LOW[np.clip(size - 8, 0, 8)]
    out[:, 2] = size.astype(np.uint64) + (long.astype(np.uint64) << np.uint64(62))
    far = np.zeros(0, np.uint32)
    if long.any():
        far, own = points[_spread(starts[long], size[long])], size[long]
        ends = np.cumsum(own)
        out[long, 0], out[long, 1] = seqhash.runs(seqhash.mix(far.astype(np.uint64) + np.uint64(0x51ED27)), ends - own, ends), 0
    return out, long, far


class _Pool:
    """An array of unsigned 32-bit values that grows."""

    def __init__(self):
        self.held, self.size = np.zeros(0, np.uint32), 0

    def add(self, values: np.ndarray) -> int:
        """Append values, and return where they begin."""
        begun, self.size = self.size, self.size + len(values)
        if self.size > len(self.held):
            self.held = np.concatenate([self.held[:begun], values, np.zeros(len(self.held) // 2, np.uint32)])
        else:
            self.held[begun : self.size] = values
        return begun


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some runs, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + size, size)


def _around(text: str, special: str) -> list[str]:
    parts = text.split(special)
    out = [parts[0]] if parts[0] else []
    for p in parts[1:]:
        out.append(special)
        if p:
            out.append(p)
    return out


def _segments(text: str):
    """Parts of text, cut only where a unit begins in any case; a stretch without such a place stays whole."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _SAFE_CUT.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, shown: bool = False) -> Codec:
    """The codec of a vocabulary of this process, until release()."""
    if (path, shown) not in _codecs:
        _codecs[path, shown] = Codec(path, shown)
    return _codecs[path, shown]


def release() -> None:
    """Free the codec and its tables at the end of a partition: the workers of a cluster go on to other tasks."""
    _codecs.clear()


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode every text and decode its ids.

    Returns, for every row: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256. Null and empty texts have no ids; their
    digests are those of the empty string. Strings of the vocabulary's special
    tokens become those tokens, as the library has it. Nothing is shuffled.
    """
    path = vocabulary or vocabulary_path()

    def rows(batch: pa.RecordBatch):
        c = codec(path, True)
        for part in common.slices(batch, "text", 1 << 20):
            n, ids, back = [], [], []
            texts = [x or "" for x in part.column("text").to_pylist()]
            for units in c.encode_many(texts):
                listed = b"".join([x[0] for x in units])
                n.append(listed.count(b","))
                ids.append(hashlib.sha256(listed[:-1]).hexdigest())
                back.append(hashlib.sha256(b"".join([x[1] for x in units]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", release)


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; see bpe_round_trip()."""
    path = vocabulary or vocabulary_path()

    def rows(batch: pa.RecordBatch):
        c = codec(path)
        for part in common.slices(batch, "text", 1 << 20):
            ids = [x.astype(np.int32) for x in c.arrays([x or "" for x in part.column("text").to_pylist()])]
            yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), rows, "doc_id long, ids array<int>", release)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(common.documents(spark, sf_dir))
