"""What betweenness by parts deals and walks: compressed matrices, and only pairs that a level needs."""

import numpy as np
import pyarrow as pa
import pytest

from normgraph import plans
from normgraph.operators import centrality, components, report
from normgraph.plans import pipeline, tables


@pytest.mark.parametrize("kind", ["zeros", "counts", "shares", "large", "levels", "none"])
def test_matrices_come_back_and_are_small(kind):
    rng = np.random.RandomState(1)
    x = {
        "zeros": np.where(rng.rand(4096, 50) < 0.01, 1.0, 0.0),
        "counts": rng.randint(0, 900, (4096, 50)).astype(float),
        "shares": rng.rand(4096, 50),
        "large": np.full((7, 50), 2.0**40) + rng.rand(7, 50),
        "levels": rng.randint(0, 4, (4096, 50)).astype(np.int32),
        "none": np.zeros((0, 50)),
    }[kind]
    shut = centrality._shut(x)
    assert np.array_equal(centrality._open(pa.scalar(shut, pa.binary()), 50, x.dtype), x)
    assert len(shut) < {"zeros": x.nbytes / 50, "counts": x.nbytes / 3, "levels": x.nbytes / 8}.get(kind, x.nbytes + 64)


def test_shares_of_few_values_are_dealt_as_places():
    x = 1 / np.random.RandomState(6).randint(1, 60, (4096, 50))
    shut = centrality._shut(x)
    assert np.array_equal(centrality._open(pa.scalar(shut, pa.binary()), 50), x) and len(shut) < x.nbytes / 9


def test_only_pairs_that_a_level_needs_are_walked(monkeypatch):
    rng = np.random.RandomState(2)
    v = np.sort(rng.randint(0, 60, 900))
    u, rows, to = rng.randint(0, 60, 900), np.where(rng.rand(60, 4) < 0.05, rng.rand(60, 4), 0.0), rng.rand(60, 4) < 0.1
    want = centrality._added(np.zeros((60, 4)), u, v, rows) * to
    walked, added = [], centrality._added
    monkeypatch.setattr(centrality, "_added", lambda out, u, v, rows: walked.append(len(u)) or added(out, u, v, rows))
    assert np.allclose(centrality._along(u, v, rows, to), want) and sum(walked) < 300


@pytest.mark.parametrize(("has", "asks"), [(0.02, 0.9), (0.9, 0.02), (0.0, 0.9), (0.9, 0.0)])
def test_few_numbers_go_along_their_own_pairs(monkeypatch, has, asks):
    """No whole rows are added up where few of their numbers aren't 0, or few places are asked for."""
    rng = np.random.RandomState(4)
    v = np.sort(rng.randint(0, 50, 1200))
    u, rows, to = rng.randint(0, 70, 1200), np.where(rng.rand(70, 40) < has, rng.rand(70, 40), 0.0), rng.rand(50, 40) < asks
    want = centrality._added(np.zeros((50, 40)), u, v, rows) * to
    monkeypatch.setattr(centrality, "ADDED", 64)
    monkeypatch.setattr(centrality, "_added", lambda *_: pytest.fail("whole rows"))
    assert np.allclose(centrality._along(u, v, rows, to), want)


@pytest.mark.parametrize("share", [0.0127, 0.5])
def test_cells_of_pairs_come_back_and_are_small(share):
    rng = np.random.RandomState(5)
    size = 2048
    at = np.flatnonzero(rng.rand(size * size) < share)
    at = np.concatenate([at, at[:9]])  # parallel pairs stay
    v, u = np.divmod(rng.permutation(at), size)
    shut = centrality._cell(u, v, size)
    back_u, back_v = centrality._of_cell(pa.scalar(shut, pa.binary()), size)
    assert np.array_equal(back_v * size + back_u, np.sort(at)) and len(shut) < 1.25 * len(at)


def test_roles_list_no_neighbours(spark, sf_dir, monkeypatch):
    """Roles and uncertainty need no lists, which grow with the links."""

    def refuse(*_, **__):
        raise AssertionError("not to be called")

    monkeypatch.setattr(report, "with_neighbour_labels", refuse)
    assert "neighbours" not in report.node_metrics(tables.nations(spark, sf_dir), listed=False).columns


def test_links_of_a_task_become_one_a_node():
    rng = np.random.RandomState(3)
    u, v = rng.randint(0, 300, (2, 5000))
    u, v = np.where(u % 3 == v % 3, u, v), v  # three components
    batches = [pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)[k::4]), pa.array(np.minimum(u, v)[k::4])], names=["u", "v"]) for k in range(4)]
    out = list(components._forest(iter(batches)))
    stars = {(a, b) for r in out for a, b in zip(r["u"].to_pylist(), r["v"].to_pylist())}
    assert len(stars) <= 300 and {b for _, b in stars} <= {0, 1, 2} and all(a % 3 == b for a, b in stars)
    assert not sum(r.num_rows for r in components._forest(iter([])))


def test_full_table_takes_paths_from_all_nodes(spark, sf_dir):
    """Of 500 nodes, not of the dashboard's first 200; both conventions agree but for the factor, since no edges are parallel."""
    q = plans.queries()
    want = {r.id: r.betweenness for r in q["betweenness_provisions"](spark, sf_dir).collect()}
    table = {r.id: r for r in q["full_node_table_provisions"](spark, sf_dir).collect()}
    assert {x: r.bc for x, r in table.items()} == pytest.approx({x: 2 * c for x, c in want.items()}, abs=2e-6)
    ranked = sorted(table, key=lambda x: table[x].rank_bc)
    assert [table[x].bc for x in ranked] == sorted((r.bc for r in table.values()), reverse=True)
    high, middle = (table[ranked[int(len(ranked) * share)]].bc for share in (0.1, 0.3))
    assert {x for x, r in table.items() if r.role == "KUNCI"} >= {x for x, r in table.items() if r.bc > high}
    assert {x for x, r in table.items() if r.role == "Periferal"} >= {x for x, r in table.items() if r.bc < middle}


def test_sections_keep_no_neighbours(spark, sf_dir, monkeypatch):
    """Lists of neighbours are made for the rows that show them, and not written between."""
    kept, materialize = [], pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df, name: kept.append(df.columns) or materialize(df, name))
    sections = dict(pipeline.csv_sections(tables.master(spark, sf_dir)))
    assert kept and not any("neighbours" in c for c in kept)
    every = {r.id: r.neighbours for r in sections["nodes"].collect()}
    assert len(every) == 500 and sections["nodes"].columns[-1] == "neighbours"
    for name in ("degree", "betweenness"):
        assert len(rows := {r.id: r.neighbours for r in sections[name].collect()}) == 50
        assert rows == {x: every[x] for x in rows} and all(rows.values())
