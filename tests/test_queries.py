"""Every registered query: against its SQL, or, where there is none, against brute force on the same graph."""

from collections import defaultdict, deque

import pytest

from harness import compare
from loomgraph.operators.algorithms import nodes
from loomgraph.plans.queries import ORACLES, QUERIES, bought, trade

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, QUERIES, ORACLES, name, FOLDER) == ""


def edges(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def neighbours(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
        else:
            near[a]
    return near


def table(spark, name, *columns):
    return {tuple(r[c] for c in columns) for r in QUERIES[name](spark, FOLDER).collect()}


def test_k_core(spark):
    near = neighbours(edges(bought(spark, FOLDER)))
    left, core, k = {v: set(n) for v, n in near.items()}, {}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        k += not low
        for v in low:
            core[v] = k
            for w in left.pop(v):
                if w in left:
                    left[w].discard(v)
    assert table(spark, "algo_k_core", "node", "core") == set(core.items())


def test_k_truss(spark):
    near = neighbours(edges(trade(spark, FOLDER)))
    held = {(a, b) for a in near for b in near[a] if a < b}
    while True:
        weak = {(a, b) for a, b in held if sum((min(a, c), max(a, c)) in held and (min(b, c), max(b, c)) in held for c in near if c not in (a, b)) < 2}
        if not weak:
            break
        held -= weak
    assert table(spark, "algo_k_truss", "src", "dst") == held


def test_label_propagation(spark):
    near = neighbours(edges(bought(spark, FOLDER)))
    label = {v: v for v in near}
    for _ in range(4):
        new = {}
        for v in near:
            votes = defaultdict(int)
            for w in near[v]:
                votes[label[w]] += 1
            new[v] = min(votes, key=lambda x: (-votes[x], x)) if votes else label[v]
        label = new
    assert table(spark, "algo_label_propagation", "node", "community") == set(label.items())


def test_spanning_forest(spark):
    pairs = edges(bought(spark, FOLDER))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    total = count = 0
    for w, a, b in sorted(((a * 7 + b) % 11, a, b) for a, b in pairs):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total, count = total + w, count + 1
    got = QUERIES["algo_spanning_forest"](spark, FOLDER).collect()
    up.clear()
    weight = {(min(a, b), max(a, b)): (a * 7 + b) % 11 for a, b in pairs}
    for r in got:
        assert weight[r["src"], r["dst"]] == r["weight"] and find(r["src"]) != find(r["dst"])
        up[find(r["src"])] = find(r["dst"])
    assert (len(got), sum(r["weight"] for r in got)) == (count, total)


def test_colouring(spark):
    near = neighbours(edges(trade(spark, FOLDER)))
    colour = dict(table(spark, "algo_colouring", "node", "colour"))
    assert set(colour) == {v for v in near if near[v]} and all(colour[v] != colour[w] for v in near for w in near[v])
    assert all({colour[w] for w in near[v]} >= set(range(colour[v])) for v in colour)


def test_random_walk(spark):
    graph = trade(spark, FOLDER)
    pairs, out = set(edges(graph)), QUERIES["algo_random_walk"](spark, FOLDER).collect()
    assert {r["start"] for r in out} == {r["node"] for r in nodes(graph).collect()} and len(out) == len({r["start"] for r in out})
    for r in out:
        v = r["nodes"]
        assert v[0] == r["start"] and all(p in pairs for p in zip(v, v[1:])) and (len(v) == 6 or not any(a == v[-1] for a, _ in pairs))


def test_betweenness(spark):
    pairs = [p for p in edges(trade(spark, FOLDER)) if p[0] != p[1]]
    to, every = defaultdict(list), {x for p in edges(trade(spark, FOLDER)) for x in p}
    for a, b in pairs:
        to[a].append(b)
    score = dict.fromkeys(every, 0.0)
    for s in every:
        depth, paths, queue, order = {s: 0}, defaultdict(float, {s: 1.0}), deque([s]), []
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in to[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in to[v] if depth[w] == depth[v] + 1)
            if v != s:
                score[v] += delta[v]
    got = dict(table(spark, "algo_betweenness", "node", "score"))
    assert set(got) == set(score) and all(abs(got[v] - score[v]) < 1e-6 for v in score)


def test_bridges(spark):
    near = neighbours(edges(bought(spark, FOLDER)))
    order, low, found = {}, {}, set()
    for root in near:
        stack = [(root, None, iter(near[root]))] if root not in order else []
        if stack:
            order[root] = low[root] = len(order)
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        found.add((min(v, parent), max(v, parent)))
    assert table(spark, "algo_bridges", "src", "dst") == found


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLES) == {f"algo_{x}" for x in ("k_core", "k_truss", "label_propagation", "spanning_forest", "colouring", "random_walk", "betweenness", "bridges")}
