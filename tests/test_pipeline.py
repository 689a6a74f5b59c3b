"""Folders and incidents to graphs, reports and exports."""

import json

import numpy as np

from normgraph import sources
from normgraph.operators.embedding import embed
from normgraph.operators.similarity import Pairs, pair_percentile
from normgraph.plans import pipeline

TOPICS = {"privacy": "consent data subject privacy controller processing", "risk": "risk management oversight audit system safety", "fraud": "fraud bank account identity theft loan"}


def folder(tmp_path, name, docs):
    for path, titles in docs.items():
        target = tmp_path / name / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(f"Article {k} {TOPICS[t]} {TOPICS[t]} provision" for k, t in enumerate(titles, 1)))
    return str(tmp_path / name)


def test_run(spark, tmp_path):
    intl = folder(tmp_path, "intl", {"a_binding_international_instrument/Act_2024.pdf": ["privacy", "risk"], "b_global_soft_law/Principles.pdf": ["risk"]})
    natl = folder(tmp_path, "natl", {"a_binding_national_regulation/UU_2022.pdf": ["privacy", "fraud"]})
    facts = {"subjek_pelaku": TOPICS["fraud"]}
    (tmp_path / "i.json").write_text(json.dumps({"incidents": [{"id": "case-1", "peristiwa_hukum_kronologi": TOPICS["fraud"], "pemetaan_fakta_hukum": facts, "year": 2023}]}))
    read = lambda d: sources.extract_texts(sources.list_files(spark, d))
    nodes = pipeline.corpus(read(intl), read(natl), sources.read_incidents(spark, str(tmp_path / "i.json")))
    assert [r.ord for r in nodes.orderBy("ord").collect()] == [0, 1, 2, 3, 4, 5]
    graph = pipeline.build(nodes)
    edges = {(r.src, r.dst, r.type) for r in graph.edges.collect()}
    assert edges == {
        ("Act_2024_Article_2", "Principles_Article_1", "semantic_link"),
        ("Act_2024_Article_1", "IDN_UU_2022_Article_1", "cross_jurisdiction"),
        ("IDN_UU_2022_Article_2", "CASE_CASE-1", "governs"),
    }
    out = str(tmp_path / "out")
    audit = {r.output: (r.n_nodes, r.n_edges) for r in pipeline.run(spark, graph, out).collect()}
    assert audit == {"legal": (6, 3), "intl": (3, 1), "natl": (2, 0), "cross": (6, 1), "incident": (6, 1), "gap": (4, 3)}
    text = "\n".join(r.value for r in spark.read.text(f"{out}/reports/master").collect())
    assert "## Coverage" in text and "| +" not in text
    assert sources.exists(spark, f"{out}/csv/05-nodes")
    by_rank = pipeline.build(nodes, thresholds={"intl": "p0", "natl": 0.7, "cross": 0.55, "governs": 0.5})
    assert by_rank.edges.where("type = 'semantic_link'").count() >= 1


def test_percentile_over_all_scores(spark):
    x = np.random.RandomState(3).normal(size=(40, 3))
    x[1] = -x[0]
    rows = [(f"n{k}", k, f"n{k}", f"g{k % 4}", "c", 2000, "t", "intl" if k % 4 < 2 else "natl") for k in range(40)]
    nodes = spark.createDataFrame(rows, "id string, ord long, label string, group string, classification string, year int, text string, side string")
    vectors = spark.createDataFrame([(f"n{k}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    pairs = {
        "intl": [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 < 2 and b % 4 < 2 and a % 4 != b % 4],
        "cross": [(a, b) for a in range(40) for b in range(40) if a % 4 < 2 <= b % 4],
    }
    expected = set()
    for p, found in pairs.items():
        scores = np.array([cosine[a, b] for a, b in found])
        cut = np.percentile(scores, {"intl": 30, "cross": 80}[p]) - 1e-12
        expected |= {(f"n{a}", f"n{b}") for (a, b), s in zip(found, scores) if s >= cut}
    graph = pipeline.build(nodes, lambda _: vectors, {"intl": "p30", "natl": 2.0, "cross": "p80", "governs": 2.0})
    assert {(r.src, r.dst) for r in graph.edges.collect()} == expected
    own = nodes.join(vectors, "id")
    across = Pairs(own.where("side = 'intl'"), 0.0, own.where("side = 'natl'"))
    for p, few in ((0, 1000), (12.5, 5), (90, 1000), (100, 5)):
        assert np.isclose(pair_percentile(across, f"p{p}", block=7, few=few), np.percentile(scores, p), atol=1e-11)


def test_encoder(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "id string, text string")
    got = {r.id: r.vector for r in embed(df, lambda ts: np.array([[len(t), 1.0] for t in ts]), batch=2).collect()}
    assert np.allclose(got["a"], np.array([2, 1]) / np.sqrt(5)) and got["b"] == [0.0, 1.0]
