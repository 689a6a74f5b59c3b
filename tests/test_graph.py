"""Micro graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from normgraph.functions import bands
from normgraph.model import INCIDENT, Graph
from normgraph.operators import components
from normgraph.operators import graph as g
from normgraph.operators import report
from normgraph.operators.centrality import betweenness
from normgraph.operators.ranking import global_rank, head, top, value_at
from normgraph.operators.similarity import Pairs, similar_pairs
from tests.conftest import rows_of


def make(spark, nodes, edges, groups=None, classes=None):
    n = [(x, k, x, (groups or {}).get(x, x), (classes or {}).get(x), 2000 + k) for k, x in enumerate(nodes)]
    e = [(a, b, "link", 1.0, k) for k, (a, b) in enumerate(edges)]
    return Graph(
        spark.createDataFrame(n, "id string, ord long, label string, `group` string, classification string, year int"),
        spark.createDataFrame(e, "src string, dst string, type string, weight double, ord long"),
    )


SHAPES = {
    "path": ("abcd", ["ab", "bc"], {"b": 1 / 3}),
    "star": ("cabde", ["ca", "cb", "cd", "ce"], {"c": 1.0}),
    "bridge": ("abcdef", ["ab", "bc", "ac", "de", "ef", "df", "cd"], {"c": 0.6, "d": 0.6}),
    "pair": ("ab", ["ab"], {}),
    "single": ("a", [], {}),
    "empty": ("", [], {}),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_betweenness(spark, shape):
    nodes, edges, expected = SHAPES[shape]
    graph = make(spark, nodes, edges)
    want = {x: expected.get(x, 0.0) for x in nodes}
    for limit in (4_000_000, 0):
        got = {r.id: r.betweenness for r in betweenness(graph, broadcast_edges=limit).collect()}
        assert got == pytest.approx(want)
    got = {r.id: r.betweenness for r in betweenness(graph, "dashboard").collect()}
    assert got == pytest.approx({k: 2 * v for k, v in want.items()})


def test_betweenness_samples_the_first_nodes(spark):
    graph = make(spark, "abcd", ["ab", "bc", "cd"])
    got = {r.id: r.betweenness for r in betweenness(graph, "dashboard", max_sources=2).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 4 / 3, "c": 4 / 3, "d": 0.0})


def test_density_and_centrality(spark):
    value = lambda n, e, c: g.density(make(spark, n, e), c).first().density
    assert value("abcd", ["ab", "bc"], "networkx") == pytest.approx(1 / 3)
    assert [value("", [], c) for c in ("networkx", "dashboard")] == [0, 0]
    assert value("ab", ["ab", "ab"], "dashboard") == 2.0
    assert g.degree_centrality(make(spark, "a", [])).first().dc == 1.0
    assert g.degree_centrality(make(spark, "a", []), 0.0).first().dc == 0.0


def test_simple_graph_folds_parallel_edges(spark):
    graph = make(spark, "ab", ["ab", "ba", "ab"])
    assert {r.id: r.degree for r in g.degrees(graph).collect()} == {"a": 3, "b": 3}
    assert [(r.src, r.dst) for r in graph.simple().edges.collect()] == [("a", "b")]
    assert {r.id: r.degree for r in g.degrees(make(spark, "a", ["aa"])).collect()} == {"a": 2}


def test_modularity_and_components(spark):
    classes = {x: "1" if x in "abc" else "2" for x in "abcdef"}
    graph = make(spark, "abcdef", ["ab", "bc", "ac", "de", "ef", "df", "cd"], classes=classes)
    assert report.modularity(graph).first().q == pytest.approx(0.357143, abs=1e-6)
    s = report.component_summary(make(spark, "abcd", ["ab", "bc"])).first()
    assert tuple(s) == (2, 3, 1, 1)
    assert tuple(report.component_summary(make(spark, "", [])).first()) == (0, 0, 0, 0)
    assert report.modularity(make(spark, "ab", [])).first().q == 0


def lowest(pairs):
    """Union-find: every node's smallest reachable node."""
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    return {x: root(x) for x in up}


def test_components_of_many_shapes(spark, monkeypatch):
    rng = random.Random(3)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:]))
    pairs += [(2000, 2001 + k) for k in range(30)] + [(3030, 3000 + k) for k in range(30)]  # a hub that is smallest, and one that is largest
    pairs += [(a, b) for a in range(4000, 4008) for b in range(4000, a)] + [(5000, 5001), (5001, 5000), (5002, 5001)]
    pairs += [(rng.randrange(6000, 6080), rng.randrange(6000, 6080)) for _ in range(60)]
    rounds = []
    materialized = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: rounds.append(name) or materialized(df, name))
    frame = spark.createDataFrame([*pairs, (7, 7), (None, 8), (9, None)], "a long, b long")
    want = lowest([(a, b) for a, b in pairs if a != b])
    assert {r.node: r.component for r in components.connected_components(frame, "a", "b").collect()} == want
    assert rounds.count("stars") > 1
    rounds.clear()
    stars = spark.createDataFrame([(k, v) for k, v in want.items() if k != v], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(stars, "a", "b").collect()} == want
    assert rounds == ["stars"]  # settled as they come: no round at all
    assert components.connected_components(stars.limit(0), "a", "b").isEmpty()


def test_contraction_keeps_cross_group_edges(spark):
    groups = dict(zip("abcdef", "xxyyzz"))
    graph = make(spark, "abcdef", ["ab", "ac", "bd", "ce", "fa"], groups)
    small = g.contract(graph)
    assert {(r.src, r.dst): r.weight for r in small.edges.collect()} == {("x", "y"): 2.0, ("y", "z"): 1.0, ("x", "z"): 1.0}
    assert {r.id: r.value for r in small.nodes.collect()} == {"x": 10, "y": 10, "z": 10}


def test_contraction_of_edges_that_bring_their_ends_numbers(spark):
    graph = make(spark, "abcdef", ["ab", "ac", "bd", "ec", "fa"], dict(zip("abcdef", "zzyyxx")))
    place = {x: k for k, x in enumerate("abcdef")}
    numbered = spark.createDataFrame([(*r, place[r.src], place[r.dst]) for r in graph.edges.collect()], "src string, dst string, type string, weight double, ord long, a long, b long")
    for edges in (graph.edges, numbered):
        small = g.contract(Graph(graph.nodes, edges))
        assert {(r.src, r.dst): (r.weight, r.type, r.ord) for r in small.edges.collect()} == {("z", "y"): (2.0, "link", 1), ("y", "x"): (1.0, "link", 3), ("z", "x"): (1.0, "link", 4)}


def test_warrants(spark):
    classes = {"r": "Natl: a", "s": "Intl: b", "t": "Other", "i": INCIDENT, "j": INCIDENT, "k": INCIDENT, "l": INCIDENT}
    graph = make(spark, "rstijkl", ["ri", "si", "jr", "tk"], classes=classes)
    got = {r.incident: (r.warrant, r.n_warrants, r.prefixes) for r in report.warrant_classes(graph).collect()}
    assert got == {"i": ("both", 2, "Intl, Natl"), "j": ("natl", 1, "Natl"), "k": ("other", 1, "Othe"), "l": ("none", 0, "")}
    assert {r.warrant: r.n for r in report.warrant_distribution(graph).collect()} == {"none": 1, "natl": 1, "intl": 0, "both": 1}
    assert [(r.rank, r.regulation, r.n) for r in report.captures(graph).orderBy("rank").collect()] == [(1, "r", 2), (2, "s", 1), (3, "t", 1)]


def test_neighbourhood(spark):
    graph = make(spark, "cabdefg", ["ca", "cb", "cd", "ce", "cf", "cg"])
    got = {r.id: (r.degree, r.neighbours, r.more) for r in g.inspector(graph).collect()}
    assert got["c"] == (6, "a; b; d; e; f", 1) and got["a"] == (1, "c", 0)


def test_thematic_edges_need_both_ends(spark):
    graph = make(spark, "ab", ["ab"])
    extra = spark.createDataFrame([("a", "b", "t", 0), ("a", "z", "t", 1)], "src string, dst string, type string, ord long")
    assert g.with_thematic(graph, extra).edges.count() == 2


def test_ranks(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "ord long, v long")
    want = sorted(((-(k % 3), k) for k in range(50)))
    got = {r.ord: r.rank for r in global_rank(df, F.col("v")).collect()}
    assert [got[k] for _, k in want] == list(range(1, 51))
    assert [r.ord for r in top(df, F.col("v"), 3).orderBy("rank").collect()] == [2, 5, 8]
    assert value_at(df.withColumn("v", F.col("v").cast("double")), "v", 0.5).first().value == 1.0
    assert value_at(df.limit(0).withColumn("v", F.col("v").cast("double")), "v", 0.5).first().value == 0.0
    assert [r.more for r in head(df, 48).collect() if r.more] == [2] and head(df, 60).count() == 50


def test_similarity_blocks(spark):
    import numpy as np

    rng = np.random.RandomState(2)
    rows = [(k, f"g{k % 4}", [float(x) for x in rng.normal(0, 1, 6)]) for k in range(80)]
    df = spark.createDataFrame([*rows, (90, "g0", None), (91, "g1", [0.0] * 6), (92, "g2", [1.0, 2.0])], "ord long, `group` string, vector array<double>")
    unit = {k: (c, np.array(v) / np.linalg.norm(v)) for k, c, v in rows}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a][0] != unit[b][0] and unit[a][1] @ unit[b][1] >= 0.4}
    for block in (2048, 9):
        assert {(r.src, r.dst) for r in similar_pairs(Pairs(df, 0.4), block).collect()} == want
    left, right = df.where("ord < 40"), df.where("ord >= 40")
    want = {(a, b) for a in unit for b in unit if a < 40 <= b and unit[a][1] @ unit[b][1] >= 0.4}
    for block in (2048, 9):
        assert {(r.src, r.dst) for r in similar_pairs(Pairs(left, 0.4, right, cross_group=False), block).collect()} == want
    assert similar_pairs(Pairs(df.limit(0), 0.4)).count() == 0


def test_bands(spark):
    def label(expr):
        return spark.range(1).select(expr.alias("x")).first().x

    tiers = [label(bands.weight_tier(F.lit(w))) for w in (0.95, 0.9499, 0.80, 0.7999, 0.79996)]
    assert tiers == ["Identik", "Sangat Kuat", "Sangat Kuat", "Lemah", "Sangat Kuat"]
    assert [label(bands.cluster_status(F.lit(k), F.lit(100))) for k in (71, 70, 31, 30)] == ["KRITIS", "PERHATIAN", "PERHATIAN", "MODERAT"]
    assert [label(bands.legal_uncertainty(F.lit(d), F.lit(dc), F.lit(bc))) for d, dc, bc in ((0, 0, 0), (5, 0.16, 0.009), (1, 0.029, 0.004), (3, 0.1, 0.1))] == ["KRITIS", "TINGGI", "SEDANG", "RENDAH"]
    assert label(bands.edge_label(F.lit("cross_jurisdiction"), F.lit(0.712))) == "cross jurisdiction (Lemah 71.2%)"
    assert label(bands.edge_label(F.lit("governs"), F.lit(0.0))) == "governs"
    assert label(bands.label_percent(F.lit("x (Sim 71.2%)"), 0.05)) == pytest.approx(0.712)
    assert label(bands.label_percent(F.lit("x (Tier 71.2%)"), 0.05)) == 0.05


def test_rows_do_not_depend_on_input_order(spark):
    graph = make(spark, "abcdef", ["ab", "bc", "ac", "de"])
    mixed = Graph(graph.nodes.orderBy(F.rand(1)), graph.edges.orderBy(F.rand(2)))
    for f in (g.degrees, report.clusters, report.node_metrics, g.neighbour_labels):
        assert rows_of(f(graph)) == rows_of(f(mixed))


def random_graph(spark, n, chance, seed):
    import random

    pick = random.Random(seed)
    edges = [(a, b) for a in range(n) for b in range(a) if pick.random() < chance]
    # two cliques that a bridge joins, and nodes without an edge
    edges += [(n + a, n + b) for a in range(6) for b in range(a)] + [(n + 6 + a, n + 6 + b) for a in range(6) for b in range(a)] + [(n, n + 6)]
    nodes = spark.createDataFrame([(f"n{k}", k, f"n{k}", "g", "c", 2000) for k in range(n + 14)], "id string, ord long, label string, `group` string, classification string, year int")
    links = spark.createDataFrame([(f"n{a}", f"n{b}", "t", 1.0, k) for k, (a, b) in enumerate(edges)], "src string, dst string, type string, weight double, ord long")
    return Graph(nodes, links)


def test_shares_of_all_pairs_are_betweenness(spark, monkeypatch):
    """Every ordered pair drawn once, frontiers not broadcast: the mean share is the exact value."""
    from normgraph.operators import centrality

    monkeypatch.setattr(centrality, "FRONTIER_ROWS", 0)
    graph = random_graph(spark, 16, 0.18, 3)
    n = 30
    draws = spark.createDataFrame([(a * n + b, a, b) for a in range(n) for b in range(n) if a != b], "sample long, s long, t long")
    shares = centrality.pair_dependencies(centrality.adjacent_pairs(graph, False), draws)
    got = {r.node: r.total / ((n - 1) * (n - 2)) for r in shares.groupBy("node").agg(F.sum("share").alias("total")).collect()}
    want = {r.ord: r.betweenness for r in betweenness(graph).collect()}
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-12) and max(want.values()) > 0.04


def test_estimates_are_within_their_error(spark):
    from normgraph.operators import centrality

    graph = random_graph(spark, 40, 0.2, 1)
    want = {r.id: r.betweenness for r in betweenness(graph).collect()}
    found = centrality.betweenness_estimate(graph, error=0.2, seed=1, batch=100).collect()
    assert len(found) == len(want) and len({r.samples for r in found}) == 1
    assert all(abs(r.betweenness - want[r.id]) <= r.error for r in found) and 0 < found[0].error <= 0.2
    assert found[0].samples < 54 * 53
    tiny = Graph(graph.nodes.limit(2), graph.edges.limit(0))
    assert [r.betweenness for r in centrality.betweenness_estimate(tiny).collect()] == [0.0, 0.0]
