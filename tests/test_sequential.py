"""Algorithms that go step by step, against brute force on small random graphs."""

import random
from itertools import combinations

import pytest

from loomgraph.operators import sequential as Q


def graph(seed, n=12, m=16):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def frame(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src long, dst long" + (", weight double" if len(pairs[0]) > 2 else ""))


def parts(pairs, without=None):
    near = {}
    for a, b in pairs:
        if without not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        else:
            for x in (a, b):
                if x != without:
                    near.setdefault(x, set())
    n, seen = 0, set()
    for v in near:
        if v not in seen:
            n += 1
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_and_blocks(spark, seed):
    pairs = graph(seed)
    nodes = {x for p in pairs for x in p}
    want = {v for v in nodes if parts(pairs, v) > parts(pairs)}
    assert {r["node"] for r in Q.articulation_points(frame(spark, pairs)).collect()} == want
    blocks = {}
    for r in Q.biconnected_components(frame(spark, pairs)).collect():
        blocks.setdefault(r["component"], set()).add(r["node"])
    assert {v for v in nodes if sum(v in b for b in blocks.values()) > 1} == want
    for a, b in pairs:  # each edge lies in one block, which no node of it parts
        own = [x for x in blocks.values() if {a, b} <= x]
        assert len(own) == 1
        inside = [p for p in pairs if set(p) <= own[0]]
        assert all(parts(inside, v) <= 1 for v in own[0]) or len(inside) == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_cliques_and_matching(spark, seed):
    pairs = graph(seed, 10, 22)
    near = {x: {y for p in pairs for y in p if x in p and y != x} for p in pairs for x in p}
    linked = [set(c) for k in range(1, len(near) + 1) for c in combinations(sorted(near), k) if all(b in near[a] for a, b in combinations(c, 2))]
    assert sorted(r["clique"] for r in Q.maximal_cliques(frame(spark, pairs)).collect()) == sorted(sorted(c) for c in linked if not any(c < d for d in linked))
    r = random.Random(seed)
    sides = sorted({(r.randrange(6), 100 + r.randrange(6)) for _ in range(11)})

    def most(left, taken):
        if not left:
            return 0
        (a, b), rest = left[0], left[1:]
        skip = most(rest, taken)
        return skip if a in taken or b in taken else max(skip, 1 + most(rest, taken | {a, b}))

    got = Q.bipartite_matching(frame(spark, sides)).collect()
    ends = [x for g in got for x in (g["node1"], g["node2"])]
    assert len(got) == most(sides, frozenset()) and len(ends) == len(set(ends)) and all(tuple(sorted((g["node1"], g["node2"]))) in sides for g in got)
    assert Q.bipartite_matching(frame(spark, [(1, 2), (2, 3), (1, 3)])).count() == 0


def test_flow(spark):
    r = random.Random(5)
    pairs = sorted({(a, b): float(r.randrange(1, 9)) for a, b in (r.sample(range(7), 2) for _ in range(18))}.items())
    edges = [(a, b, w) for (a, b), w in pairs]
    cut = min(sum(w for a, b, w in edges if a in s and b not in s) for k in range(6) for c in combinations([x for x in range(7) if x not in (0, 6)], k) for s in [{0, *c}])
    assert Q.max_flow(frame(spark, edges), 0, 6).first()["flow"] == cut


def test_groups_and_orders(spark):
    first, second = list(combinations(range(5), 2)), list(combinations(range(10, 15), 2))
    out = {r["node"]: r["community"] for r in Q.louvain(frame(spark, [*first, *second, (4, 10)])).collect()}
    assert out == {v: 0 if v < 5 else 10 for v in [*range(5), *range(10, 15)]}
    dense = Q.densest_subgraph(frame(spark, [*first, (4, 20), (20, 21), (21, 22)])).collect()
    assert ({r["node"] for r in dense}, {r["density"] for r in dense}) == (set(range(5)), {2.0})
    ranked = Q.vote_rank(frame(spark, [(0, k) for k in range(1, 6)] + [(5, 6), (6, 7), (6, 8)])).collect()
    assert [r["node"] for r in sorted(ranked, key=lambda r: r["rank"])][:2] == [0, 6]
    walked = Q.depth_first(frame(spark, [(1, 2), (1, 3), (2, 4), (4, 3)]), 1).collect()
    assert [(r["node"], r["depth"]) for r in sorted(walked, key=lambda r: r["place"])] == [(1, 0), (2, 1), (4, 2), (3, 3)]
    with pytest.raises(ValueError):
        Q.by_component(frame(spark, first), lambda rows: [], "node long", most=3)
