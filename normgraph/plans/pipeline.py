"""From document folders and incidents to the master graph, its sub-graphs and their reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions import bands
from normgraph.functions.text import DEFAULT_YEAR, fixed, shorten
from normgraph.model import INCIDENT, Graph
from normgraph.operators import graph as g
from normgraph.operators import report
from normgraph.operators.centrality import betweenness
from normgraph.operators.embedding import hashed_tfidf
from normgraph.operators.ranking import global_rank, head, top
from normgraph.operators.similarity import ROUNDING, THRESHOLDS, Pairs, pair_percentile, similar_pairs
from normgraph.sources import corpus_from_texts, incident_text, sinks
from normgraph.storage import materialize

#: Edge kinds: sides, type and whether both ends must be of different groups.
KINDS = (("intl", "intl", "intl", "semantic_link", True), ("natl", "natl", "natl", "semantic_link", True), ("cross", "intl", "natl", "cross_jurisdiction", True), ("governs", "reg", "inc", "governs", False))


def incident_nodes(incidents: DataFrame) -> DataFrame:
    """Incidents as (id, ord, label, group, classification, year, text)."""
    name = F.replace(F.upper("id"), F.lit(" "), F.lit("_"))
    return incidents.select(F.concat(F.lit("CASE_"), name).alias("id"), "ord", F.concat_ws(" - ", F.upper("id"), shorten(F.col("peristiwa_hukum_kronologi"))).alias("label"), F.lit(INCIDENT).alias("group"), F.lit(INCIDENT).alias("classification"), F.coalesce("year", F.lit(DEFAULT_YEAR["inc"])).alias("year"), incident_text().alias("text"))


def corpus(international: DataFrame, national: DataFrame, incidents: DataFrame) -> DataFrame:
    """One table of all nodes with side; international ones come first, then national ones, then incidents."""
    parts = [("intl", corpus_from_texts(international, "intl")), ("natl", corpus_from_texts(national, "natl", "IDN_")), ("inc", incident_nodes(incidents))]
    out, base = None, 0
    for side, rows in parts:
        rows = materialize(rows.select("id", (F.col("ord") + base).cast("long").alias("ord"), "label", "group", "classification", "year", "text").withColumn("side", F.lit(side)), f"corpus-{side}")
        base += (rows.agg(F.coalesce(F.max("ord"), F.lit(base - 1))).first()[0] - base) + 1
        out = rows if out is None else out.unionByName(rows)
    return out


def build(nodes: DataFrame, vectors: Callable[[DataFrame], DataFrame] = hashed_tfidf, thresholds: dict[str, float | str] = THRESHOLDS) -> Graph:
    """The master graph: nodes and the edges of all four kinds.

    ``vectors`` gives (id, vector) for (id, text) rows.  A threshold may be a
    number or a percentile like ``p95`` of the scores of all the kind's pairs.
    """
    v = materialize(nodes.join(vectors(nodes.select("id", "text")), "id").select("id", "ord", "group", "side", "vector"), "node-vectors")
    side = {"intl": v.where("side = 'intl'"), "natl": v.where("side = 'natl'"), "inc": v.where("side = 'inc'"), "reg": v.where("side <> 'inc'")}
    place = v.select(F.col("ord"), F.col("id"))
    edges = None
    for k, (kind, a, b, label, cross) in enumerate(KINDS):
        t = thresholds[kind]
        pairs = Pairs(side[a], 0.0 if isinstance(t, str) else float(t), None if a == b else side[b], cross)
        if isinstance(t, str):
            # the cut-off may be a pair's own score, which a second product may miss by a rounding error
            pairs = replace(pairs, threshold=pair_percentile(pairs, t) - ROUNDING)
        found = similar_pairs(pairs)
        named = found.join(place.withColumnsRenamed({"ord": "src", "id": "s"}), "src").join(place.withColumnsRenamed({"ord": "dst", "id": "d"}), "dst")
        rows = named.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(label).alias("type"), F.round("score", 4).alias("weight"), F.struct(F.lit(k).alias("kind"), "src", "dst").alias("place"))
        edges = rows if edges is None else edges.unionByName(rows)
    return Graph(nodes.drop("text", "side"), materialize(in_order(edges), "edges"))


def in_order(edges: DataFrame, place: str = "place") -> DataFrame:
    """Edges with ord, their number from 0 in the order of ``place``, which may be a struct."""
    ranked = global_rank(edges.withColumn("_all", F.lit(0)), F.col("_all"), "ord", place)
    return ranked.withColumn("ord", F.col("ord") - 1).drop("_all", place)


def subgraphs(graph: Graph) -> dict[str, Graph]:
    """The master graph and the five derived from it."""
    return {
        "legal": graph,
        "intl": g.class_subgraph(graph, "Intl:"),
        "natl": g.class_subgraph(graph, "Natl:"),
        "cross": g.typed_subgraph(graph, "cross_jurisdiction"),
        "incident": g.typed_subgraph(graph, "governs"),
        "gap": g.contract(graph),
    }


def report_tables(graphs: dict[str, Graph]) -> dict[str, list[tuple[str, DataFrame]]]:
    """Per report, its tables in order."""
    m = graphs["legal"]
    ranked = lambda x: top(g.degree_centrality(x), F.col("dc"), 10).select("rank", "id", "label", "degree", fixed(F.col("dc"), 4).alias("dc"))
    between = lambda x: top(betweenness(x), F.round("betweenness", 12), 10).select("rank", "id", fixed(F.col("betweenness"), 5).alias("betweenness"))
    alone = lambda x: head(g.isolated(x).select("id", "label", "ord"), 20).drop("ord")
    side = report.side_degrees(graphs["cross"])
    best = lambda s: top(side.where(F.col("side") == s), F.col("degree"), 15).select("rank", "id", "degree", fixed(F.col("avg_score") * 100, 1).alias("avg_score_pct"))
    return {
        "master": [("Summary", report.macro_counts(m)), ("Degree centrality", ranked(m)), ("Betweenness", between(m)), ("Isolated", alone(m)), ("Coverage", report.group_coverage(m).orderBy("group")), ("Components", report.component_summary(m))],
        "intl": [("Density", g.density(graphs["intl"])), ("Groups", report.group_coverage(graphs["intl"]).orderBy("group")), ("Degree centrality", ranked(graphs["intl"])), ("Betweenness", between(graphs["intl"])), ("Isolated", alone(graphs["intl"]))],
        "natl": [("Density", g.density(graphs["natl"])), ("Groups", report.group_coverage(graphs["natl"]).orderBy("group")), ("Degree centrality", ranked(graphs["natl"])), ("Betweenness", between(graphs["natl"])), ("Isolated", alone(graphs["natl"]))],
        "cross": [("Tiers", report.tier_distribution(graphs["cross"].edges)), ("International", best("Intl")), ("National", best("Natl")), ("Isolated", alone(graphs["cross"]))],
        "incident": [("Warrants", report.warrant_distribution(m)), ("Regulations", report.captures(m)), ("Incidents", top(report.warrant_classes(m), F.col("n_warrants"), 10).drop("ord")), ("Without", head(report.warrant_classes(m).where("warrant = 'none'").select("incident", "ord"), 15).drop("ord"))],
        "gap": [("Summary", report.macro_counts(m)), ("Coverage", report.group_coverage(m).orderBy("group")), ("Pairs", top(graphs["gap"].edges, F.col("weight"), 15).select("rank", "src", "dst", "type", "weight")), ("Isolated by class", report.isolated_by_class(m).orderBy("classification")), ("Components", report.component_summary(m))],
    }


def csv_sections(graph: Graph) -> list[tuple[str, DataFrame]]:
    """Sections of the spreadsheet export, in order."""
    m = materialize(report.node_metrics(graph, listed=False), "node-metrics")  # neighbours, which grow with the links, are never kept
    first = lambda rank: report.with_neighbours(materialize(m.where(F.col(rank) <= 50), "first-nodes"), graph, some=True).orderBy(rank)
    return [
        ("metrics", report.metrics_table(graph)),
        ("degree", first("rank_dc").select("rank_dc", "id", "label", "group", "classification", "degree", "dc", "dominance", "uncertainty", "neighbours")),
        ("betweenness", first("rank_bc").select("rank_bc", "id", "label", "group", "classification", "degree", "bc", "role", "neighbours")),
        ("clusters", report.clusters(graph).orderBy(F.col("size").desc(), "ord").drop("ord")),
        ("holes", g.isolated(graph).orderBy("ord").select("id", "label", "group", "classification", *[c.alias(n) for n, c in bands.hole(F.col("classification")).items()])),
        ("nodes", report.with_neighbours(m, graph).orderBy("ord").drop("ord")),
        ("edges", report.edge_list(graph).orderBy(F.col("ord").asc_nulls_last()).drop("ord")),
    ]


def run(spark: SparkSession, graph: Graph, folder: str) -> DataFrame:
    """Write every graph, report and export, which take ``folder``'s place together; returns the audit.

    Any failure stops the run and leaves the folder as it was.
    """
    graphs = subgraphs(graph)
    with sinks.published(spark, folder) as staged:
        for name, x in graphs.items():
            if name == "gap":
                sinks.write_contraction(x, f"{staged}/{name}")
            else:
                sinks.write_graph(x, f"{staged}/{name}", "Degree" if name == "legal" else "Degree Semantik", name == "legal")
        for name, tables in report_tables(graphs).items():
            text = sinks.markdown_report(name, tables)
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{staged}/reports/{name}")
        sinks.write_csv_sections(csv_sections(graph), f"{staged}/csv")
    return sinks.audit(spark, graphs)
