"""Biconnected blocks and betweenness by them, against plain searches."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from normgraph.operators import centrality
from normgraph.operators.blocks import blocks
from tests.test_graph import make


def depth_first(near):
    """Blocks as sets of nodes, by the lowest place that a subtree reaches."""
    place, low, stack, out = {}, {}, [], []

    def go(x, up):
        place[x] = low[x] = len(place)
        for y in sorted(near[x] - {up}):
            if y not in place:
                stack.append((x, y))
                go(y, x)
                low[x] = min(low[x], low[y])
                if low[y] >= place[x]:
                    at = stack.index((x, y))
                    out.append(frozenset(n for e in stack[at:] for n in e))
                    del stack[at:]
            elif place[y] < place[x]:
                stack.append((x, y))
                low[x] = min(low[x], place[y])

    for x in sorted(near):
        if x not in place:
            go(x, None)
    return out


def reach(near, start, without):
    """Nodes that a path from ``start`` reaches which enters none of ``without``."""
    seen, todo = {start}, [start]
    while todo:
        for y in near[todo.pop()]:
            if y not in seen and y not in without:
                seen.add(y)
                todo.append(y)
    return seen


def many_shapes():
    """Cliques, rings and trees that share nodes, bridges, paths, hubs, random parts, in a mixed order of names."""
    rng = random.Random(11)
    edges = [(a, b) for a in range(6) for b in range(a)] + [(5, 6), (6, 7), (7, 8), (8, 6)]
    edges += [(20 + k, 20 + (k + 1) % 7) for k in range(7)] + [(23, 5), (23, 30), (30, 31), (30, 32)]
    edges += [(40, 41 + k) for k in range(12)] + [(41, 42), (43, 44), (44, 45)]
    edges += [(60 + k, 61 + k) for k in range(4)]
    edges += [(80 + rng.randrange(18), 80 + rng.randrange(18)) for _ in range(21)]
    names = list(range(100))
    rng.shuffle(names)
    return [(names[a], names[b]) for a, b in edges if a != b]


def test_blocks_of_many_shapes(spark):
    edges = many_shapes()
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    starts = {x for x in near if x % 3 == 0}
    pairs = spark.createDataFrame([p for a, b in edges for p in ((a, b), (b, a))], "u long, v long")
    found = blocks(pairs, spark.createDataFrame([(x,) for x in range(0, 300, 3)], "node long"))
    members, inside = defaultdict(dict), defaultdict(Counter)
    for r in found.members.collect():
        assert r.node not in members[r.block]
        members[r.block][r.node] = r
    want = depth_first(near)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, want))
    for rows in members.values():
        for x, r in rows.items():
            hung, all_of = reach(near, x, set(rows)), reach(near, x, set())
            assert (r.weight, r.starts, r.total, r.total_starts) == (len(hung), len(hung & starts), len(all_of), len(all_of & starts))
    for r in found.pairs.collect():
        assert {r.u, r.v} <= set(members[r.block])
        inside[r.block][r.u, r.v] += 1
    assert sum(inside.values(), Counter()) == Counter(p for a, b in edges for p in ((a, b), (b, a)))  # parallel pairs stay
    empty = blocks(pairs.limit(0), pairs.select(F.col("u").alias("node")).limit(0))
    assert empty.members.isEmpty() and empty.pairs.isEmpty()


def carried(near, sources):
    """Ordered pairs' shares of shortest paths through each node; ``near`` counts parallel edges."""
    total = Counter()
    for s in sources:
        depth, paths, order = {s: 0}, Counter({s: 1}), [s]
        for x in order:
            for y, many in near[x].items():
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x] * many
        share = Counter()
        for y in reversed(order):
            for x, many in near[y].items():
                if depth[x] == depth[y] - 1:
                    share[x] += paths[x] * many / paths[y] * (1 + share[y])
            if y != s:
                total[y] += share[y]
    return total


@pytest.mark.parametrize("held", ["tasks", "batches", "joins", "mixed"])
def test_betweenness_by_blocks(spark, monkeypatch, held):
    if held == "batches":
        monkeypatch.setattr(centrality, "STEPS", 40)
        monkeypatch.setattr(centrality, "SHARED_PAIRS", 8)
    edges = many_shapes()
    nodes = [str(k) for k in range(104)]  # some have no edge
    graph = make(spark, nodes, [(str(a), str(b)) for a, b in edges])
    bound = {"tasks": 2_000_000, "batches": 2_000_000, "joins": 0, "mixed": 20}[held]
    n, near = len(nodes), defaultdict(Counter)
    for a, b in edges:
        near[a][b] += 1
        near[b][a] += 1
    single = {x: Counter(dict.fromkeys(ys, 1)) for x, ys in near.items()}
    sums = carried(defaultdict(Counter, single), range(n))
    got = {r.ord: r.betweenness for r in centrality.betweenness(graph, broadcast_edges=0, block_pairs=bound).collect()}
    assert got == pytest.approx({k: sums[k] / ((n - 1) * (n - 2)) for k in range(n)})
    if held in ("batches", "mixed"):
        sums = carried(near, range(30))
        got = {r.ord: r.betweenness for r in centrality.betweenness(graph, "dashboard", 30, broadcast_edges=0, block_pairs=bound).collect()}
        assert got == pytest.approx({k: sums[k] * n / 30 * 2 / ((n - 1) * (n - 2)) for k in range(n)})


def random_graph():
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)] + [(50 + k, 51 + k) for k in range(5)]
    near = defaultdict(Counter)
    for a, b in edges:
        if a != b:
            near[a][b] += 1
            near[b][a] += 1
    return near


@pytest.mark.parametrize("levels", [1, 12])
def test_sources_together(monkeypatch, levels):
    """Several sources at once give what searches one by one give, which go on where there are too many levels."""
    monkeypatch.setattr(centrality, "TOGETHER", 4)
    monkeypatch.setattr(centrality, "LEVELS", levels)
    monkeypatch.setattr(centrality, "ADDED", 50)
    near = random_graph()
    names = sorted(near)
    lists = [[names.index(y) for y in sorted(near[x]) for _ in range(near[x][y])] for x in names]
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = centrality._dependencies(np.arange(len(names)), start, np.concatenate(lists), len(names))
    want = carried(near, names)
    assert got.tolist() == pytest.approx([want[x] for x in names])


def test_sums_by_parts(spark, monkeypatch):
    """No task holds the graph: parts of seven nodes, batches of five sources, several components."""
    monkeypatch.setattr(centrality, "PART", 7)
    monkeypatch.setattr(centrality, "SOURCES", 5)
    near = random_graph()
    pairs = spark.createDataFrame([(x, y) for x in near for y in near[x] for _ in range(near[x][y])], "u long, v long")
    nodes = spark.createDataFrame([(x, 1.0, float(x % 9 == 0)) for x in sorted(near)], "ord long, weight double, starts double")
    want = carried(near, [x for x in near if x % 9 == 0])
    got = {r.ord: r.carried for r in centrality._by_parts(pairs, nodes).collect()}
    assert {x: got.get(x, 0.0) for x in near} == pytest.approx({x: float(want[x]) for x in near})
