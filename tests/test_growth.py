"""Similarity joins that skip cells, and graphs that grow by batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normgraph.operators import growth, similarity
from normgraph.operators.components import connected_components
from normgraph.operators.growth import GrowingGraph
from normgraph.operators.similarity import Pairs, cell_counts, dealt, pair_percentile, similar_pairs

SCHEMA = "ord long, `group` string, vector array<double>"


def clustered(n, seed=1, clusters=20, d=24, spread=0.12):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(clusters, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = centres[rng.randint(clusters, size=n)] + rng.normal(0, spread / np.sqrt(d) * 3, (n, d))
    return [(k, f"g{k % 7}", [float(x) for x in v]) for k, v in enumerate(rows)]


AWKWARD = [(9001, "a", [0.0] * 24), (9002, "b", None), (9003, "c", [1.0, None] * 12), (9004, "d", [1.0, 0.5]), (9005, "e", [1.0, 0.4]), (None, "f", [1.0] * 24), (9006, None, [1.0] * 24), (9007, None, [1.0] * 24), (9008, "x", [])]


def by_hand(left, right, threshold, cross=True):
    found = set()
    ok = lambda r: r[0] is not None and r[2] and None not in r[2]
    for i, a in enumerate(left):
        for b in left[i + 1 :] if right is None else right:
            if ok(a) and ok(b) and len(a[2]) == len(b[2]) and not (cross and a[1] == b[1]):
                x, y = np.array(a[2]), np.array(b[2])
                norm = np.linalg.norm(x) * np.linalg.norm(y)
                if (x @ y / norm if norm else 0.0) >= threshold:
                    found.add((a[0], b[0]) if right is not None else (min(a[0], b[0]), max(a[0], b[0])))
    return found


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.3, 0.7, 0.95])
def test_rings_lose_no_pair(spark, threshold):
    rows = clustered(260) + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA)
    found = [(r.src, r.dst) for r in similar_pairs(Pairs(df, threshold), block=16).collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand(rows, None, threshold)
    a, b = rows[::2], rows[1::2]
    found = [(r.src, r.dst) for r in similar_pairs(Pairs(spark.createDataFrame(a, SCHEMA), threshold, spark.createDataFrame(b, SCHEMA), cross_group=False), block=16).collect()]
    assert len(found) == len(set(found)) and set(found) == by_hand(a, b, threshold, cross=False)


def test_most_cells_of_clustered_rows_are_skipped(spark):
    side = dealt(spark.createDataFrame(clustered(4000), SCHEMA), 64)
    met, skipped = cell_counts(side, None, 0.7)
    assert met + skipped == len(side.rings.low) * (len(side.rings.low) + 1) // 2
    assert skipped > 3 * met
    assert cell_counts(side, None, -1.0)[1] == 0
    # what is skipped is not shuffled either
    cells = similarity._cells_by_pivots(side, None, 0.7)
    assert cells.select("p", "q").distinct().count() == met


def test_copies_of_one_row_are_dealt_to_many_blocks(spark):
    df = spark.range(600).selectExpr("id AS ord", "concat('g', id % 3) AS `group`", "array(1D, 2D) AS vector")
    side = dealt(df, 50)
    assert len(side.rings.low) == 12 and side.rows.groupBy("block").count().agg({"count": "max"}).first()[0] < 100
    assert similar_pairs(Pairs(df, 0.99), block=50).count() == 600 * 400 // 2


def test_percentiles_between_two_clusters_of_scores(spark):
    """The two ranks lie in bins far apart, each with many scores."""
    base = np.eye(2)
    rows = [(k, f"g{k}", [float(x) for x in base[k % 2] + np.array([1e-7, 2e-7]) * k]) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    v = np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores = (v @ v.T)[np.triu_indices(60, 1)]
    for p in ("p0", "p49", "p50", "p50.85", "p99.9", "p100"):
        assert np.isclose(pair_percentile(Pairs(df, 0), p, block=16, few=10), np.percentile(scores, float(p[1:])), atol=1e-10), p


def test_a_grown_graph_is_the_rebuilt_one(spark, tmp_path):
    rows = clustered(1500, seed=3) + AWKWARD
    order = np.random.RandomState(5).permutation(len(rows)).tolist()
    graph = GrowingGraph(spark, str(tmp_path / "graph"), 0.7, block=32)
    assert graph.edges().count() == 0 and graph.components().count() == 0
    cells = []
    for part in ([], order[:1200], order[1200:1350], order[1350:], order[:30]):  # the last is there already
        cells.append(graph.add(spark.createDataFrame([rows[k] for k in part], SCHEMA)))
    whole = spark.createDataFrame(rows, SCHEMA)
    edges = {(r.src, r.dst) for r in graph.edges().collect()}
    assert edges == {(r.src, r.dst) for r in similar_pairs(Pairs(whole, 0.7), block=10_000).collect()} and graph.edges().count() == len(edges)
    expected = {tuple(r) for r in connected_components(graph.edges(), "src", "dst").collect()}
    assert {tuple(r) for r in graph.components().collect()} == expected and len(expected) > 1000
    # a tenth of the rows takes a small part of the cells of building anew
    rebuilt = cell_counts(dealt(whole, 32), None, 0.7)
    assert cells[0] == cells[4] == (0, 0) and max(cells[2][0], cells[3][0]) < rebuilt[0] / 2


def test_a_batch_that_fails_leaves_the_former_version(spark, tmp_path, monkeypatch):
    rows = clustered(60)
    graph = GrowingGraph(spark, str(tmp_path / "graph"), 0.7, block=16)
    graph.add(spark.createDataFrame(rows[:40], SCHEMA))
    before = sorted(map(tuple, graph.edges().collect()))
    monkeypatch.setattr(GrowingGraph, "_merged", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        graph.add(spark.createDataFrame(rows[40:], SCHEMA))
    monkeypatch.undo()
    assert graph.version() == 1 and sorted(map(tuple, graph.edges().collect())) == before
    graph.add(spark.createDataFrame(rows[40:], SCHEMA))
    assert {(r.src, r.dst) for r in graph.edges().collect()} == by_hand(rows, None, 0.7)


def test_a_grown_graph_deals_no_links_and_keeps_single_numbers(spark, tmp_path, monkeypatch):
    """Of very many links few are dealt for components, and vectors of single numbers are kept as such, also beside double ones."""
    rows = [r for r in clustered(400, seed=4, clusters=2)]
    single = spark.createDataFrame(rows, SCHEMA).withColumn("vector", F.col("vector").cast("array<float>"))
    kinds = [single.where("ord % 3 = 0"), single.where("ord % 3 = 1"), spark.createDataFrame([r for r in rows if r[0] % 3 == 2], SCHEMA)]
    graph, dealt_links, whole = GrowingGraph(spark, str(tmp_path / "graph"), 0.5, block=64), [], growth.connected_components
    monkeypatch.setattr(growth, "connected_components", lambda e, *a: (dealt_links.append(e.count()), whole(e, *a))[1])
    for batch in kinds:
        graph.add(batch)
    assert [spark.read.parquet(p["rows"]).schema["vector"].dataType.elementType.simpleString() for p in graph._parts()] == ["float", "float", "double"]
    every = single.withColumn("vector", F.col("vector").cast("array<double>")).where("ord % 3 <> 2").unionByName(kinds[2])
    want = {(r.src, r.dst) for r in similar_pairs(Pairs(every, 0.5)).collect()}
    assert {(r.src, r.dst) for r in graph.edges().collect()} == want and graph.edges().count() == len(want) > 20_000
    assert {tuple(r) for r in graph.components().collect()} == {tuple(r) for r in whole(graph.edges(), "src", "dst").collect()}
    assert sum(dealt_links) < len(want) / 4
