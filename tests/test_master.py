"""The master graph's edges are written once, as they are found, and only where a query needs them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normgraph.operators import similarity
from normgraph.operators.similarity import Pairs, pair_percentile, similar_pairs
from normgraph.plans import queries, tables


def refuse(*_, **__):
    raise AssertionError("not to be called")


def test_incidents_by_year_needs_no_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "similar_pairs", refuse)
    monkeypatch.setattr(tables, "_graphs", {})
    assert queries()["incidents_by_year"](spark, sf_dir).count() > 0


def test_edges_are_not_ranked(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "_graphs", {})
    monkeypatch.setattr(tables, "in_order", refuse)
    edges = tables.master(spark, sf_dir).edges.collect()
    monkeypatch.undo()
    monkeypatch.setattr(tables, "END_BITS", 1)  # ords that don't fit are ranked
    monkeypatch.setattr(tables, "_graphs", {})
    ranked = tables.master(spark, sf_dir).edges.collect()
    plain = lambda rows: [tuple(r[c] for c in ("src", "dst", "type", "weight")) for r in sorted(rows, key=lambda r: r.ord)]
    assert len(edges) > 1000 and plain(edges) == plain(ranked) and len({r.ord for r in edges}) == len(edges)


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_cells_come_in_tiles(spark, monkeypatch, kind):
    """Scores of a cell are worked out part by part, from single numbers too."""
    rng = np.random.RandomState(3)
    rows = [(k, f"g{k % 3}", [float(np.float32(x)) for x in rng.randn(6)]) for k in range(120)]
    df = spark.createDataFrame(rows, "ord long, group string, vector array<double>").withColumn("vector", F.col("vector").cast(kind))
    v = np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = v @ v.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 3 != j % 3 and score[i, j] >= 0.4}
    monkeypatch.setattr(similarity, "SCORES", 100)
    monkeypatch.setattr(similarity, "SLICE", 7)
    for block in (None, 16, 500):
        assert {(r.src, r.dst) for r in similar_pairs(Pairs(df, 0.4), block).collect()} == want
    all_scores = [score[i, j] for i in range(120) for j in range(i + 1, 120) if i % 3 != j % 3]
    assert pair_percentile(Pairs(df, 0.0), "p90", 16) == pytest.approx(np.quantile(all_scores, 0.9))
