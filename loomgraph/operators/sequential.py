"""Graph algorithms that go step by step: each connected component is one group, solved in plain Python by one task.

They have no form as joins; a component is gathered in one task, so its size is
checked first: ValueError where one has more than `most` edges.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .algorithms import connected_components

#: Edges of a component that a task takes.
MOST = 2_000_000


def by_component(edges: DataFrame, solve: Callable[[pd.DataFrame], Iterable[tuple]], schema: str, most: int = MOST) -> DataFrame:
    """solve() of the edges (src, dst, weight) of each component, sorted; its rows are of the schema."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    step = written(edges.select("src", "dst", weight.alias("weight")))
    part = written(connected_components(step))
    held = step.join(part.withColumnRenamed("node", "src"), "src")
    large = held.groupBy("component").count().filter(F.col("count") > most)
    if not large.isEmpty():
        raise ValueError(f"a component of more than {most} edges")
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "dst", "weight"]).reset_index(drop=True)
        return pd.DataFrame(list(solve(rows)), columns=names)

    return held.groupBy("component").applyInPandas(run, schema)


def _neighbours(rows: pd.DataFrame) -> dict[int, list[int]]:
    """Neighbours in either direction, sorted, without loops."""
    out: dict[int, set[int]] = defaultdict(set)
    for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
        out[a]
        out[b]
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _low_points(near: dict[int, list[int]]) -> tuple[set[int], list[set[int]]]:
    """Cut vertices, and the nodes of each block, of a connected graph: one depth-first search without recursion."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    cut: set[int] = set()
    blocks: list[set[int]] = []
    edges: list[tuple[int, int]] = []
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        if not near[root]:
            blocks.append({root})
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    edges.append((v, w))
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent and order[w] < order[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[v])
                if low[v] >= order[parent]:
                    block: set[int] = set()
                    while True:
                        e = edges.pop()
                        block.update(e)
                        if e == (parent, v):
                            break
                    blocks.append(block)
                    if parent == root:
                        children += 1
                    else:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return cut, blocks


def articulation_points(edges: DataFrame) -> DataFrame:
    """node of every node whose loss parts its component."""
    return by_component(edges, lambda rows: [(v,) for v in sorted(_low_points(_neighbours(rows))[0])], "node long")


def biconnected_components(edges: DataFrame) -> DataFrame:
    """node, component: the blocks of the graph, each named by its two least nodes; cut vertices stand in several."""

    def solve(rows):
        return [(v, "-".join(map(str, sorted(b)[:2]))) for b in _low_points(_neighbours(rows))[1] for v in sorted(b)]

    return by_component(edges, solve, "node long, component string")


def bipartite_matching(edges: DataFrame) -> DataFrame:
    """node1, node2 of a maximum matching of the bipartite components, by Hopcroft and Karp; other components have none."""

    def solve(rows):
        near = _neighbours(rows)
        side: dict[int, int] = {}
        for root in near:
            if root in side:
                continue
            side[root], queue = 0, deque([root])
            while queue:
                v = queue.popleft()
                for w in near[v]:
                    if w not in side:
                        side[w] = 1 - side[v]
                        queue.append(w)
                    elif side[w] == side[v]:
                        return []
        left = [v for v in near if side[v] == 0]
        mate: dict[int, int | None] = dict.fromkeys(near)
        while True:
            level = {v: 0 for v in left if mate[v] is None}
            queue, found = deque(level), False
            while queue:
                v = queue.popleft()
                for w in near[v]:
                    x = mate[w]
                    if x is None:
                        found = True
                    elif x not in level:
                        level[x] = level[v] + 1
                        queue.append(x)
            if not found:
                break
            for root in left:
                if mate[root] is not None:
                    continue
                path, tried = [root], {root: iter(near[root])}
                while path:
                    v = path[-1]
                    for w in tried[v]:
                        x = mate[w]
                        if x is None:
                            free = w
                            for u in reversed(path):  # each takes the node that is free, and frees its own
                                taken, mate[u], mate[free] = mate[u], free, u
                                free = taken
                            path = []
                            break
                        if level.get(x) == level[v] + 1 and x not in tried:
                            tried[x] = iter(near[x])
                            path.append(x)
                            break
                    else:
                        level.pop(v, None)
                        path.pop()
        return [(v, mate[v]) for v in left if mate[v] is not None]

    return by_component(edges, solve, "node1 long, node2 long")


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """clique (sorted nodes), size of every maximal clique, by Bron and Kerbosch with a pivot."""

    def solve(rows):
        near = {k: set(v) for k, v in _neighbours(rows).items()}
        out, stack = [], [([], set(near), set())]
        while stack:
            held, maybe, not_ = stack.pop()
            if not maybe and not not_:
                out.append((sorted(held), len(held)))
                continue
            pivot = max(sorted(maybe | not_), key=lambda u: len(near[u] & maybe))
            for v in sorted(maybe - near[pivot]):
                stack.append(([*held, v], maybe & near[v], not_ & near[v]))
                maybe = maybe - {v}
                not_ = not_ | {v}
        return sorted(out)

    return by_component(edges, solve, "clique array<long>, size long")


def densest_subgraph(edges: DataFrame) -> DataFrame:
    """node, density of the densest of the graphs that are left when the node of least degree goes again and again; of each component."""

    def solve(rows):
        near = {k: set(v) for k, v in _neighbours(rows).items()}
        import heapq

        heap = [(len(v), k) for k, v in near.items()]
        heapq.heapify(heap)
        m, gone, order = sum(map(len, near.values())) // 2, set(), []
        best, kept = m / max(len(near), 1), 0
        while heap:
            d, v = heapq.heappop(heap)
            if v in gone or d != len(near[v]):
                continue
            gone.add(v)
            order.append(v)
            for w in near[v]:
                near[w].discard(v)
                heapq.heappush(heap, (len(near[w]), w))
            m -= d
            left = len(near) - len(gone)
            if left and m / left > best:
                best, kept = m / left, len(order)
        return [(v, best) for v in sorted(order[kept:])]

    return by_component(edges, solve, "node long, density double")


def vote_rank(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, rank: who gets most votes of its neighbours is elected, votes no more, and weakens its neighbours' votes by the inverse of the mean degree; of each component."""

    def solve(rows):
        near = _neighbours(rows)
        mean = sum(map(len, near.values())) / max(len(near), 1)
        vote, out = dict.fromkeys(near, 1.0), []
        score = {v: float(len(near[v])) for v in near}
        while most is None or len(out) < most:
            left = [v for v in near if v not in {x for x, _ in out}]
            if not left:
                break
            v = max(left, key=lambda u: (score[u], -u))
            if score[v] <= 1e-12:
                break
            out.append((v, len(out) + 1))
            for u, less in [(v, vote[v]), *[(w, min(vote[w], 1 / mean)) for w in near[v]]]:
                vote[u] -= less
                for w in near[u]:
                    score[w] -= less
        return out

    return by_component(edges, solve, "node long, rank long")


def louvain(edges: DataFrame, rounds: int = 10, tolerance: float = 0.0001) -> DataFrame:
    """node, community (its least node): nodes move to the neighbouring community of the highest gain of modularity until none moves, communities become nodes, and again.

    Communities never cross components, so each is solved apart, with the weight
    of the whole graph in the gain.
    """
    total = edges.filter("src <> dst").agg(F.sum("weight") if "weight" in edges.columns else F.count("*")).first()[0]
    total = float(total or 1)

    def solve(rows):
        links: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for a, b, w in rows[["src", "dst", "weight"]].itertuples(index=False, name=None):
            links[a][a] += 0.0
            links[b][b] += 0.0
            if a != b:
                links[a][b] += w
                links[b][a] += w
        home = {v: v for v in links}
        before = None
        for _ in range(rounds):
            degree = {v: sum(x.values()) for v, x in links.items()}
            group = {v: v for v in links}
            weight = dict(degree)
            moved_any, moved = False, True
            while moved:
                moved = False
                for v in sorted(links):
                    own = group[v]
                    to: dict[int, float] = defaultdict(float)
                    for w, x in links[v].items():
                        if w != v:
                            to[group[w]] += x
                    weight[own] -= degree[v]
                    gain = lambda c, to=to, v=v: to.get(c, 0.0) - degree[v] * weight[c] / (2 * total)
                    best = max(sorted({own, *to}), key=lambda c: (round(gain(c), 12), c == own))
                    weight[best] += degree[v]
                    if best != own:
                        group[v], moved, moved_any = best, True, True
            home = {v: group[c] for v, c in home.items()}
            merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
            for v, x in links.items():
                for w, y in x.items():
                    merged[group[v]][group[w]] += y
            links = merged
            now = sum(x.get(c, 0.0) / (2 * total) - (sum(x.values()) / (2 * total)) ** 2 for c, x in links.items())
            if not moved_any or (before is not None and abs(now - before) < tolerance):
                break
            before = now
        least: dict[int, int] = {}
        for v, c in home.items():
            least[c] = min(least.get(c, v), v)
        return [(v, least[c]) for v, c in sorted(home.items())]

    return by_component(edges, solve, "node long, community long")


def depth_first(edges: DataFrame, source: int, both: bool = False) -> DataFrame:
    """node, depth in the order of a depth-first search from source, the least neighbour first."""
    flat = edges.select("src", "dst")

    def solve(rows):
        near: dict[int, list[int]] = defaultdict(list)
        for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
            near[a].append(b)
            if both:
                near[b].append(a)
        if source not in set(rows["src"]) | set(rows["dst"]):
            return []
        seen, out, stack = set(), [], [(source, 0)]
        while stack:
            v, depth = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            out.append((v, depth, len(out)))
            stack += [(w, depth + 1) for w in sorted(set(near[v]), reverse=True) if w not in seen]
        return out

    return by_component(flat, solve, "node long, depth int, place long")


def max_flow(edges: DataFrame, source: int, sink: int) -> DataFrame:
    """One row, flow: the most that goes from source to sink along edges (src, dst, weight: capacity), by shortest augmenting paths."""

    def solve(rows):
        room: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for a, b, w in zip(rows["src"].tolist(), rows["dst"].tolist(), rows["weight"].tolist(), strict=True):
            if a != b:
                room[a][b] += w
                room[b][a] += 0.0
        if source not in room or sink not in room or source == sink:
            return []
        flow = 0.0
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                v = queue.popleft()
                for w, x in sorted(room[v].items()):
                    if x > 1e-12 and w not in came:
                        came[w] = v
                        queue.append(w)
            if sink not in came:
                return [(flow,)]
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            least = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= least
                room[b][a] += least
            flow += least

    return by_component(edges, solve, "flow double").unionByName(edges.sparkSession.createDataFrame([(0.0,)], "flow double")).agg(F.max("flow").alias("flow"))
