"""The corpus operators against brute force, round trips and held-out accuracy, on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harness import compare
from loomgraph.llm import bpe, common, decontamination, exact_dedup, language_id, line_dedup, ngram_join, registry, repeats, seqhash, substring_dedup, suffix_array_dedup, token_records, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, `n_lines` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "x", None) for i, t in rows], SCHEMA).repartition(3)


def odd(seed=1):
    """Rows with nulls, empties, repeats, near copies, a long text, and ties."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(60, 140))) for _ in range(6)]
    rows = [(n, t) for n, t in enumerate(base)]
    for n in range(10, 22):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = "changed"
        rows.append((n, " ".join(w) if n % 2 else "\n".join([" ".join(w[:70]), " ".join(w[70:]), "a line of some length", "a line of some length"[:15]])))
    rows += [(30, None), (31, ""), (32, "  \n "), (33, "short"), (None, base[0]), (34, base[1]), (34, base[1]), (35, base[2].upper()), (36, "ab " * 4000), (37, "ab " * 3000)]
    return rows


def windows_gone(items, n):
    """Brute force: which tokens stand in a run of n that also starts in a document of a smaller id."""
    first = {}
    for i, toks in items:
        for a in range(len(toks) - n + 1):
            k = tuple(toks[a : a + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, toks in items:
        gone = [False] * len(toks)
        for a in range(len(toks) - n + 1):
            if first[tuple(toks[a : a + n])] < i:
                gone[a : a + n] = [True] * n
        out.append((i, gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = odd(seed)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 10**9, r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(table(spark, rows)).collect())
    items = [(10**9 if i is None else i, (t or "").encode().split()) for i, t in rows]
    want = sorted((i, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for (i, w), (_, g) in zip(items, windows_gone(items, 50)))
    assert got == want


def test_suffix_array_dedup(spark):
    rows = odd(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 10**9, r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_array_dedup.suffix_array_dedup(table(spark, rows)).collect())
    items = [(10**9 if i is None else i, (t or "").encode()) for i, t in rows]
    want = sorted((i, len(w), sum(g), bytes(x for x, y in zip(w, g) if not y)) for (i, w), (_, g) in zip(items, windows_gone(items, 50)))
    assert got == want


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_anchors_of_many_texts(kind, monkeypatch):
    """The texts of a part go through numpy together, and each has the anchors and contexts that it has alone."""
    r = random.Random(5)
    unit = (lambda n: "".join(r.choice("abé ") for _ in range(n))) if kind == "bytes" else (lambda n: " ".join(r.choice("abcdef") for _ in range(n)))
    texts = ["", unit(49), *(unit(r.randint(0, 400)) for _ in range(300)), "", unit(50), "a " * 200, unit(40_000), ""]
    tokens = repeats.Tokens(kind, 8, 50)

    def batch(rows):
        return pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["_id", "_key", "_text"])

    def anchors(rows):
        return [x for out in repeats._anchor_rows(tokens, True)(batch(rows)) for x in zip(*(c.to_pylist() for c in out.columns))]

    rows, calls, one = list(enumerate(texts)), [], seqhash.minimizers
    alone = [x for row in rows for x in anchors([row])]
    monkeypatch.setattr(seqhash, "minimizers", lambda *a: calls.append(1) or one(*a))
    assert anchors(rows) == alone and len(calls) < 5
    at = {}
    for h, _, i, _, p in alone:
        at.setdefault(i, []).append({"h": h, "ps": [p + 3, p], "hot": p % 2 == 0})
    some = sorted(at)
    listed = pa.array([at[i] for i in some], pa.list_(pa.struct([("h", pa.int64()), ("ps", pa.list_(pa.int64())), ("hot", pa.bool_())])))
    got = [tuple(x.values()) for out in repeats._context_rows(tokens)(batch([rows[i] for i in some]).append_column("at", listed)) for x in out.to_pylist()]
    want = []
    for i in some:
        v = np.frombuffer(texts[i].encode(), np.uint8) if kind == "bytes" else seqhash.words(texts[i].encode())[2]
        for x in at[i]:
            p = x["ps"][1]
            a = max(p - 42, 0)
            want.append((x["h"], i, 0, x["ps"], p - a, v[a : p + 50].tobytes(), x["hot"]))
    assert got == want
    for i, t in rows:  # each window holds an anchor
        n, ps = len(t.encode() if kind == "bytes" else t.split()), np.array([x["ps"][1] for x in at.get(i, [])], int)
        assert all(((ps >= a) & (ps <= a + 42)).any() for a in range(n - 49))


def test_repeated_runs(monkeypatch):
    """Against brute force; elements that share no run of that length aren't sorted for it."""
    r = np.random.default_rng(6)
    n, k, length = 400, 4, 10
    group, ids = np.sort(r.integers(0, 20, n)), r.integers(0, 300, n)
    nleft, nright = r.integers(0, 7, n), r.integers(4, 11, n)
    left, right = np.zeros((n, 6), np.uint8), np.zeros((n, 10), np.uint8)
    for i in range(n):
        left[i, : nleft[i]] = r.integers(0, 2 + group[i], nleft[i])
        right[i, : nright[i]] = r.integers(0, 2 + group[i], nright[i])
        right[i, :4] = group[i]
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **kw: sizes.append(len(x)) or sort(x, **kw))
    found = repeats.repeated_runs(group, ids, left, nleft, right, nright, k, length)
    first, runs = {}, {}
    for i in range(n):
        for d in range(k, length + 1):
            if d <= nright[i] and length - d <= nleft[i]:
                runs[i, d] = (group[i], d, *left[i, : length - d], -1, *right[i, :d])
                first[runs[i, d]] = min(first.get(runs[i, d], 1000), ids[i])
    want = [[(i, d) in runs and first[runs[i, d]] < ids[i] for d in range(k, length + 1)] for i in range(n)]
    assert found.tolist() == want and found.any()
    assert sum(sizes[2:]) < n * (length - k + 1) * 0.8


def test_written_side_by_side(spark):
    """Two values of a column go to files of their own without a sort, and settings stay as they were."""
    held = common.written(spark.range(100).withColumn("even", F.col("id") % 2 == 0), by="even", beside=2)
    last = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert "Sort" not in last.apply(last.size() - 1).physicalPlanDescription()
    assert held.filter("even").count() == 50 and held.count() == 100
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_maximal_repeats():
    assert suffix_array_dedup.maximal_repeats([b"xabcy", b"zabcw", b"abq"], 2) == [(b"ab", [(0, 1), (1, 1), (2, 0)]), (b"abc", [(0, 1), (1, 1)])]


def test_exact_dedup(spark):
    rows = odd() + [(40, "A" * 300 + "x"), (41, "a" * 300 + "X"), (42, "a" * 300), (43, "A" * 256), (44, "a" * 256)]
    out = exact_dedup.exact_dedup(table(spark, rows)).collect()
    lower = lambda t: (t or "").encode().lower()
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max((x for x in by[lower(t)] if x is not None), default=None)), len(by[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(by)


def test_line_dedup(spark):
    rows = [(1, "a line of some length here\n\nab\nab"), (2, "a line of sOme length here\nanother line that stays\nabc"), (3, "a line of some lengthhere \n\nab"), (4, None), (5, ""), (5, "a line of some length here")]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {(1, "a line of some length here\n\nab"), (2, "another line that stays\nabc"), (3, ""), (4, None), (5, "")}
    assert line_dedup.line_dedup(table(spark, rows)).columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "n_lines", "n_removed"]


def components_by_hand(rows):
    sets = {n: frozenset(ngram_join.shingles((t or "").encode()).tolist()) for n, (_, t) in enumerate(rows)}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[find(b)] = find(a)
    groups = {}
    for n, (i, _) in enumerate(rows):
        groups.setdefault(find(n), []).append(i)
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_ngram_join(spark):
    rows = odd()
    out = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        groups.setdefault(r["class_id"], []).append(str(r["doc_id"]))
    assert sorted(sorted(g) for g in groups.values()) == components_by_hand(rows)
    assert len(components_by_hand(rows)) == ngram_join.one_of_each(table(spark, rows)).count()
    assert 1 - (1 - 0.8 ** ngram_join.prefix_depth()) ** ngram_join.TREES >= ngram_join.RECALL


def links_by_hand(rows, threshold):
    """Brute force: the groups of doc_ids, and the links of each: the other rows of its set, and the other sets as similar."""
    sets = {i: frozenset(ngram_join.shingles(t.encode()).tolist()) for i, t in rows}
    other, near = set(sets.values()), {}
    for x in other:
        near[x] = [y for y in other if x != y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y)]
    least = {x: min(i for i in sets if sets[i] == x) for x in other}
    while True:
        after = {x: min([least[x], *(least[y] for y in near[x])]) for x in other}
        if after == least:
            break
        least = after
    copies = {x: sum(y == x for y in sets.values()) for x in other}
    return {i: (least[x], len(near[x]) + copies[x] - 1) for i, x in sets.items()}


def fresh(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def near_by_query(spark, rows, threshold):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(table(spark, rows), threshold).collect()}


def of_a_template(r, pairs):
    """Pairs of linked texts that all hold one boilerplate: nodes of as many components as there are pairs."""
    boiler, out = fresh(r, 60), []
    for _ in range(pairs):
        end = fresh(r, 20)
        out += [" ".join([*boiler, *fresh(r, 20), *end]) for _ in range(2)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_join_of_a_node_of_many_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block, raising=False)
    rows = of_a_template(random.Random(5), 60)
    want = links_by_hand(rows, 0.5)
    assert len({c for c, _ in want.values()}) == 60
    assert near_by_query(spark, rows, 0.5) == want


def test_ngram_join_of_links_between_inner_members(spark):
    """Two components of a node whose only link joins their hubs, which need not be the first or last of theirs."""
    r = random.Random(6)
    texts = []
    for _ in range(8):
        boiler = fresh(r, 130)
        for hub in (boiler + fresh(r, 60), boiler + fresh(r, 60)):
            texts.append(" ".join(hub))
            for at in (3, 11, 20, 28, 36, 45, 53, 62, 71, 80):
                texts.append(" ".join([*hub[:at], *fresh(r, 40), *hub[at + 40 :]]))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = links_by_hand(rows, 0.5)
    assert len({c for c, _ in want.values()}) == 8
    assert near_by_query(spark, rows, 0.5) == want


def test_ngram_join_counts_all_links(spark):
    """Texts all near one another: each has links to all others, whatever their order by hash."""
    r = random.Random(7)
    base, rows = fresh(r, 200), []
    for i, at in enumerate(r.sample(range(200), 40)):
        w = list(base)
        w[at] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(40, rows[0][1]), (41, rows[0][1])]
    want = links_by_hand(rows, 0.8)
    assert {n for _, n in want.values()} == {39, 41}
    assert near_by_query(spark, rows, 0.8) == want
    links = ngram_join.ngram_jaccard_join(table(spark, rows))[1].collect()
    assert len(links) == len({(x["a"], x["b"]) for x in links}) == 40 * 39 // 2


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, "no such thing here at all my friend"), (3, None), (None, item), (4, "tiny item")], "item_id long, text string")
    w = item.split()
    rows = [(1, f"before {item.upper()}, after"), (2, " ".join(["x", *w[6:], "y z", *w[:6]])), (3, " ".join(w[:5]) + " nothing else"), (4, None), (5, ""), (6, "Tiny item!"), (None, item), (7, "clean text of its own"), (8, "a tiny item here")]
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontamination.decontaminate(table(spark, rows), bench).collect()}
    assert got == {1: (True, [1]), 2: (True, [1]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (True, [4]), None: (True, [1]), 7: (False, []), 8: (False, [])}
    assert sorted(r["doc_id"] for r in decontamination.without_contaminated(table(spark, rows), bench).collect()) == [3, 4, 5, 7, 8]


def tiles_by_hand(item, doc, shortest=5):
    """Greedy string tiling as it is defined: the longest match of free tokens is marked, the first of equal ones, until none has `shortest`."""
    free, out = ([True] * len(item), [True] * len(doc)), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and free[0][p + n] and free[1][q + n] and item[p + n] == doc[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < shortest:
            return sorted(out)
        free[0][p : p + n], free[1][q : q + n] = [False] * n, [False] * n
        out.append((p, q, n))


def covered_by_hand(items, text):
    """Item ids, with the share that tiles cover, that a text holds."""
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()  # noqa: E731  of ASCII texts
    out = {}
    for i, t in items:
        a, b = tokens(t or ""), tokens(text or "")
        if i is None or not a:
            continue
        share = sum(n for _, _, n in tiles_by_hand(a, b)) / len(a) if len(a) >= 5 else float(a == b)
        if share >= 0.5:
            out[i] = max(out.get(i, 0), share)
    return out


def benchmark_rows(r, n):
    """Items of few words, some of which are long, short, repeated or null; and texts that hold passages of them, in any order."""
    word = lambda: f"w{r.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(r.choice([2, 4, 12, 20, 45])))) for i in range(n)] + [(n, None), (None, "no id at all here today"), (0, "an item that shares its id with another one")]
    texts = []
    for k in range(60):
        parts = [word() for _ in range(r.randrange(25))]
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            a = r.randrange(len(own) + 1)
            parts[r.randrange(len(parts) + 1) : 0] = own[a:] + [word()] * r.randrange(2) + own[:a]
        texts.append((k, " ".join(parts)))
    return items, [*texts, (100, items[0][1]), (101, f"{items[1][1]}."), (102, None), (103, ""), (104, "?")]


def test_decontamination_is_brute_force(spark):
    items, rows = benchmark_rows(random.Random(11), 12)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], round(r["coverage"], 9)) for r in decontamination.decontaminate(table(spark, rows), bench).collect()}
    want = {i: covered_by_hand(items, t) for i, t in rows}
    assert got == {i: (sorted(x), round(max(x.values(), default=0.0), 9)) for i, x in want.items()}
    assert sum(map(bool, want.values())) > 10


def test_greedy_tiles_are_those_of_the_definition():
    r = random.Random(12)
    for _ in range(150):
        a, b = ([r.randrange(3) for _ in range(r.randrange(1, 60))] for _ in range(2))
        got, want = decontamination.greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64)), tiles_by_hand(a, b)
        assert got == want


def test_greedy_tiles_cover_what_longest_matches_cover():
    a, b = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64), np.array([6, 7, 8, 9, 10, 99, 1, 2, 3, 4, 5], np.uint64)
    assert decontamination.greedy_tiles(a, b) == [(0, 6, 5), (5, 0, 5)]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    whole, small = Tokenizer.from_file(path), bpe.Codec(path, long=30, leaf=7)
    r = random.Random(2)
    texts = ["", "a" * 5000, " " * 900 + "x", "it's <|endoftext|> here\n\n  now", "漢字😀é" * 60] + ["".join(r.choice("ab 's\n1.é<|endoftext|>漢") for _ in range(r.randint(1, 90))) for _ in range(400)]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        for c in (small, bpe.codec(path), bpe.codec(path, True)):
            assert c.encode(t) == want
        assert small.decode(want) == whole.decode(want, skip_special_tokens=False) == t
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "x"), (500, None)]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_round_trip(table(spark, rows)).collect()}
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_array_lookup_is_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    whole = Tokenizer.from_file(path)
    r = random.Random(4)
    parts = [*" \n\t'ab\u00e9\u00df1,.-", "  ", " the", "\u3000", " \u2003x", "\u65e5", "'s", "\xa0", "\U0001f642", "\x85", "don't", "<|endoftext|>"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(0, 90))) for _ in range(1500))]
    for segment, kept in ((1 << 20, 1 << 20), (30, 50)):  # one segment each; many, and a table that starts again
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        monkeypatch.setattr(bpe, "HASHED", kept)
        got = bpe.Codec(path).arrays(texts)
        assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(size):
    """Two different sequences of two values that sums of powers modulo 2**64 don't tell apart."""
    t = [0]
    while len(t) < size:
        t += [1 - x for x in t]
    return "".join("xq"[x] for x in t), "".join("qx"[x] for x in t)


@pytest.mark.parametrize("size", [2048, 4096])
def test_sequences_that_a_polynomial_modulo_two_to_64_confuses(spark, size):
    from tokenizers import Tokenizer

    a, b = thue_morse(size)
    assert len(set(seqhash.words(f"{a} {b} {a}".encode())[2].tolist())) == 2
    whole = Tokenizer.from_file(bpe.vocabulary_path())
    want = [whole.encode(x, add_special_tokens=False).ids for x in (a, b, a + " " + b)]
    assert [x.tolist() for x in bpe.Codec(bpe.vocabulary_path()).arrays([a, b, a + " " + b])] == want
    rows = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([a] * 50))]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()} == {1: 0, 2: 0, 3: 50}
    lines = [(1, b), (2, a), (3, a[:-1]), (4, b[1:])]
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, lines)).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_array_lookup_compares_texts(monkeypatch):
    """With a hash that makes all units one, ids still are the library's."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path())
    c = bpe.Codec(bpe.vocabulary_path())
    monkeypatch.setattr(seqhash, "mix", lambda x: x * np.uint64(0))
    for texts in (["word"], ["some words of a text", "others"], ["word"], ["wort"], ["Donaudampfschifffahrt", "Donaudampfschiffskran", "\u6f22\u5b57"], ["Donaudampfschiffsfahrt"]):
        assert [x.tolist() for x in c.arrays(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_records(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path())
    rows = [(n, t) for n, (_, t) in enumerate(odd())] + [(None, "last")]
    manifest = token_records.write_token_records(table(spark, rows), str(tmp_path / "records"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_records.read_token_records(manifest).collect()}
    start = 0
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = manifest.first()
    assert len(list(token_records.shuffled_read(shard["path"], shard["index_path"], 1))) == shard["n_docs"]
    data = bytearray(open(shard["path"], "rb").read())
    data[-6] ^= 1
    open(shard["path"], "wb").write(data)
    with pytest.raises(ValueError):
        list(token_records.shuffled_read(shard["path"], shard["index_path"], 1))


def test_language_id(spark):
    out = registry.QUERIES["op1_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd_rows = table(spark, [(1, "words of a text"), (2, None), (3, "12 34 !"), (None, "more words"), (4, "𐐀𐐁 𐐂")])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(odd_rows).collect()}
    assert got[2] == got[3] == "und" and got[1] == got[None] == got[4] == "en"


def grams_by_hand(text):
    """1- to 3-grams of the words of a text, with a blank (1) round each word, as they are packed."""
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        c = [1, *map(ord, w), 1]
        out.update(c[1:-1])
        out.update(a << 16 | b for a, b in zip(c, c[1:]))
        out.update(x << 32 | y << 16 | z for x, y, z in zip(c, c[1:], c[2:]))
    return [g for g, _ in sorted(out.items(), key=lambda x: (-x[1], x[0]))]


def test_language_id_is_brute_force(spark):
    words = {"aa": "der die das und ist nicht ein wir haben schön".split(), "bb": "the and is not one we have some good thing".split(), "cc": "le la et est pas un nous avons très bon".split()}
    r = random.Random(13)
    rows = [(n, " ".join(r.choice(words[lang]) for _ in range(r.randrange(1, 30))), lang) for n in range(90) for lang in [r.choice("aabbcc") * 2]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "1 2 ?", "cc"), (203, "gut and bon", None), (None, "the die le", "aa"), (204, "Ein THE Très", "bb")]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    learned = {}
    for i, t, x in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and x and t is not None:
            learned.setdefault(x, []).append(t)
    profiles = {x: {g: n for n, g in enumerate(grams_by_hand("\n".join(ts))[:300])} for x, ts in sorted(learned.items())}
    want = {}
    for i, t, _ in rows:
        own = grams_by_hand(t or "")[:300]
        far = {x: sum(abs(p[g] - n) if g in p else 300 for n, g in enumerate(own)) for x, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[i] = (best, round(1 - far[best] / (300 * len(own)), 9)) if own else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify_language(docs).collect()}
    assert got == want
    with pytest.raises(ValueError):
        language_id.identify_language(docs, languages=2)


def scores_by_hand(model, text):
    """The softmax of the word of a text whose n-grams have the highest mean."""
    most = None
    for w in set(toxicity.folded(text).split()):
        _, buckets, _ = toxicity.subwords(b" " + w + b" ")
        z = model.bias + float(model.logits[buckets].astype(float).mean() if len(buckets) else 0)
        most = z if most is None else max(most, z)
    return 1 / (1 + np.exp(-(model.bias if most is None else most)))


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels).cache()
    out = scored.join(labels, "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.85
    model = toxicity.learn(docs, labels)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in scored.collect():
        assert abs(r["score"] - scores_by_hand(model, text[r["doc_id"]])) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)


def test_toxicity_of_odd_labels(spark):
    """Null, repeated and odd labels, texts that are null or empty, and labels of held-out rows, which count for nothing."""
    rows = [(n, "you vile oaf" if n % 2 else "a calm day") for n in range(60)] + [(60, None), (61, ""), (62, "v1le 0af"), (None, "vile oaf"), (63, "calm " * 60_000 + "vile oaf")]
    marks = [(n, n % 2 if zlib.crc32(str(n).encode()) % 5 else 1 - n % 2) for n in range(60)] + [(60, 1), (61, None), (62, 7), (None, 1), (3, 1), (3, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    assert all(got[n] == n % 2 for n in range(60)) and got[61] == 0 and got[None] == got[63] == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(table(spark, odd()), none).collect()} == {0}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, registry.QUERIES, registry.ORACLE_SQL, name, FOLDER) == ""


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_table(spark, name, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def line_dedup_by_hand(rows):
    """(doc_id, text) with unique ids; None last."""
    at, first = lambda i, n: (10**9 if i is None else i, n), {}
    split = {i: (t or "").split("\n") for i, t in rows}
    for i, lines in split.items():
        for n, line in enumerate(lines):
            if x := line.strip(" \t\r\v\f"):
                first[x] = min(first.get(x, at(i, n)), at(i, n))

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])

    gone = {x for x in first for y in first if len(x) >= 16 and len(y) >= 16 and first[y] < first[x] and near(x, y)}
    out = {}
    for i, t in rows:
        kept = [x for n, x in enumerate(split[i]) if not (s := x.strip(" \t\r\v\f")) or (first[s] == at(i, n) and s not in gone)]
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    """Each stage on the input that the one before left, and run(), against plain Python, with nulls, empties, ties and columns that clash."""
    from tokenizers import Tokenizer

    items, texts = benchmark_rows(random.Random(21), 12)
    rows = [(i, t) for i, t in dict(odd(5)).items()] + [(i + 100, t) for i, t in texts] + [(300 + k, t) for k, t in enumerate(x for _, x in of_a_template(random.Random(5), 6))]
    rows += [(400 + n, f"text number {n} calls you a vile oaf\nand a line that several texts have{'!' * (n % 2)}") for n in range(30)] + [(430 + n, f"text number {n} tells of a calm day in a far country\nand a line that several texts have") for n in range(30)]
    table(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(400 + n, int(n < 30)) for n in range(60)] + [(None, 1), (30, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = toxicity.learn(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = [(i, t) for i, t in rows if scores_by_hand(model, t or "") < 0.5]
    steps = [want]
    want = list(line_dedup_by_hand(want).items())
    steps.append(want)
    left = {min(g, key=lambda x: 10**9 if x == "None" else int(x)) for g in components_by_hand(want)}
    want = [(i, t) for i, t in want if str(i) in left]
    steps.append(want)
    want = [(i, t) for i, t in want if not covered_by_hand(items, t)]
    steps.append(want)
    sizes = [len(rows), *map(len, steps)]
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[4] < sizes[3] and steps[0] != steps[1]

    kept = docs
    for (_, stage), known in zip(corpus_pipeline.STAGES, steps):
        kept = common.written(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, known))
    whole = Tokenizer.from_file(bpe.vocabulary_path())
    final = []
    for i, t in want:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        final.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(str, final))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash(spark):
    """Columns named as the operators name theirs are carried, whatever they hold."""
    names = ["_key", "_row", "_text", "cells", "has_text", "kept", "cls", "node", "h", "p"]
    docs = table(spark, odd(8)).withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (toxicity.without_toxic(docs, labels), line_dedup.line_dedup(docs).drop("n_removed"), ngram_join.one_of_each(docs), decontamination.without_contaminated(docs, bench)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*names).collect()} == {tuple(names)}


def test_long_texts(spark):
    """Texts of some megabytes, longer than the blocks that operators work in, go through all of them whole."""
    r = random.Random(31)
    words = [f"{r.choice('abcdef')}{r.randrange(10**5)}" for _ in range(60_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long.replace(words[30_000], "changed", 1)), (3, " ".join(words[50_000:50_100])), (4, "x" * 150_000), (5, "x" * 150_000 + "y"), (6, long)]
    docs = table(spark, rows)
    gone = {x["doc_id"]: x["n_removed"] for x in substring_dedup.substring_dedup(docs).collect()}
    assert gone[1] == gone[4] == gone[5] == 0 and gone[6] == 60_000 and gone[3] == 100 and gone[2] == 60_000 - sum(w == "changed" for w in long.replace(words[30_000], "changed", 1).split())
    bytes_gone = {x["doc_id"]: x["n_removed"] for x in suffix_array_dedup.suffix_array_dedup(docs).collect()}
    assert bytes_gone[1] == bytes_gone[4] == 0 and bytes_gone[6] == len(long) and bytes_gone[5] == 150_000 and 0 < len(long) - bytes_gone[2] < 200
    assert {x["doc_id"]: x["keep_id"] for x in exact_dedup.exact_dedup(docs).collect()} == {1: 6, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {x["doc_id"]: x["class_id"] for x in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}
    assert {x["doc_id"]: x["n_removed"] for x in line_dedup.line_dedup(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1} or words[30_000] != "changed"
    item = spark.createDataFrame([(1, " ".join(words[40_000:40_040]))], "item_id long, text string")
    assert {x["doc_id"] for x in decontamination.decontaminate(docs, item).filter("contaminated").collect()} == {1, 2, 6}
