"""Tables of the reports: counts, coverage, contraction, warrants, modularity, holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.functions import bands
from normgraph.model import INCIDENT, Graph
from normgraph.operators.centrality import DASHBOARD_SOURCES, betweenness
from normgraph.operators.components import connected_components
from normgraph.operators.graph import degree_centrality, degrees, isolated, with_ends, with_neighbour_labels
from normgraph.operators.ranking import global_rank, top
from normgraph.storage import materialize


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def macro_counts(graph: Graph) -> DataFrame:
    """One row: nodes by side, edges, density and the share of incidents with a link."""
    d = degrees(graph)
    incident = F.col("group") == INCIDENT
    cls = F.coalesce("classification", F.lit(""))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = d.agg(F.count(F.lit(1)).alias("n_nodes"), one(cls.startswith("Intl")).alias("n_intl"), one(cls.startswith("Natl")).alias("n_natl"), one(incident).alias("n_incidents"), one(incident & (F.col("degree") > 0)).alias("n_covered"))
    m = graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return n.crossJoin(F.broadcast(m)).withColumn("density", F.when(F.col("n_nodes") <= 1, 0.0).otherwise(F.col("n_edges") / F.greatest(pairs, F.lit(1.0)))).withColumn("coverage_pct", ratio(F.col("n_covered"), F.col("n_incidents")) * 100)


def group_coverage(graph: Graph) -> DataFrame:
    """Per group: nodes, connected ones, share in percent, degree sum and links to other groups; its class is its first node's."""
    per_node = degrees(graph)
    out = with_ends(graph.edges, graph.nodes, ("group",), "inner").where("src_group <> dst_group")
    cross = out.select(F.explode(F.array("src_group", "dst_group")).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("cross_edges"))
    sums = per_node.groupBy("group").agg(F.min_by("classification", "ord").alias("classification"), F.count(F.lit(1)).alias("total"), F.sum((F.col("degree") > 0).cast("long")).alias("connected"), F.sum("degree").alias("degree_sum"))
    return sums.join(cross, "group", "left").select("group", "classification", "total", "connected", (ratio(F.col("connected"), F.col("total")) * 100).alias("coverage_pct"), "degree_sum", F.coalesce("cross_edges", F.lit(0)).alias("cross_edges"))


def isolated_by_class(graph: Graph) -> DataFrame:
    return isolated(graph).groupBy("classification").agg(F.count(F.lit(1)).alias("n_isolated"))


def side_degrees(cross: Graph, default: float = bands.CROSS_DEFAULT) -> DataFrame:
    """(id, side, degree, avg_score) of the nodes that have cross edges; ties go by first edge."""
    ends = cross.endpoints().select("id", F.coalesce("weight", F.lit(default)).alias("score"), "ord")
    sums = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.avg("score").alias("avg_score"), F.min("ord").alias("ord"))
    return sums.join(cross.nodes.select("id", bands.prefix_class(F.coalesce("classification", "group")).alias("side")), "id")


def tier_distribution(scores: DataFrame, score: str = "weight", full: float = bands.CROSS_FULL, partial: float = bands.CROSS_PARTIAL) -> DataFrame:
    """(tier, n, pct) with all three tiers, whether or not any row has them."""
    spark = scores.sparkSession
    tiers = spark.createDataFrame([("full", 0), ("partial", 1), ("pseudo", 2)], "tier string, ord int")
    counts = scores.groupBy(bands.cross_tier(F.col(score), full, partial).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = scores.agg(F.count(F.lit(1)).alias("_all"))
    return F.broadcast(tiers).join(counts, "tier", "left").crossJoin(F.broadcast(total)).select("tier", F.coalesce("n", F.lit(0)).alias("n"), (ratio(F.coalesce("n", F.lit(0)), F.col("_all")) * 100).alias("pct"))


def warrants(graph: Graph) -> DataFrame:
    """(incident, regulation, classification, ord): the regulations linked to each incident."""
    e = with_ends(graph.edges, graph.nodes, ("classification",), "left")
    first = F.col("src_classification") == INCIDENT
    e = e.where(first | (F.col("dst_classification") == INCIDENT))
    first = F.coalesce(first, F.lit(False))
    return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("incident"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("regulation"), F.when(first, F.col("dst_classification")).otherwise(F.col("src_classification")).alias("classification"), "ord")


def warrant_classes(graph: Graph) -> DataFrame:
    """(incident, warrant, n_warrants, prefixes): none, natl, intl, both or other, for every incident."""
    cls = F.coalesce("classification", F.lit(""))
    sums = warrants(graph).groupBy("incident").agg(F.max(cls.startswith("Natl")).alias("natl"), F.max(cls.startswith("Intl")).alias("intl"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(bands.prefix_class(cls))), ", ").alias("prefixes"))
    inc = graph.nodes.where(F.col("classification") == INCIDENT).select(F.col("id").alias("incident"), "ord")
    kind = F.when(F.col("n").isNull(), "none").when(F.col("natl") & F.col("intl"), "both").when(F.col("natl"), "natl").when(F.col("intl"), "intl").otherwise("other")
    return inc.join(sums, "incident", "left").select("incident", "ord", kind.alias("warrant"), F.coalesce("n", F.lit(0)).alias("n_warrants"), F.coalesce("prefixes", F.lit("")).alias("prefixes"))


def warrant_distribution(graph: Graph) -> DataFrame:
    """(warrant, n, pct) of all incidents; the four named classes always appear, others in none."""
    spark = graph.nodes.sparkSession
    kinds = spark.createDataFrame([("none",), ("natl",), ("intl",), ("both",)], "warrant string")
    per = warrant_classes(graph)
    total = per.agg(F.count(F.lit(1)).alias("_all"))
    counts = per.groupBy("warrant").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(counts, "warrant", "left").crossJoin(F.broadcast(total)).select("warrant", F.coalesce("n", F.lit(0)).alias("n"), (ratio(F.coalesce("n", F.lit(0)), F.col("_all")) * 100).alias("pct"))


def captures(graph: Graph, k: int = 15) -> DataFrame:
    """(rank, regulation, n): the regulations with most incidents, ties in node order."""
    counts = warrants(graph).groupBy("regulation").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.join(graph.nodes.select(F.col("id").alias("regulation"), "ord"), "regulation")
    return top(placed, F.col("n"), k).select("rank", "regulation", "n")


def components(graph: Graph) -> DataFrame:
    """(id, component): the smallest ord of each node's component; a node without edges is one of its own."""
    found = connected_components(graph.numbered(), "a", "b", many=True).withColumnRenamed("node", "ord")
    return graph.nodes.join(found, "ord", "left").select("id", F.coalesce("component", "ord").alias("component"))


def component_summary(graph: Graph) -> DataFrame:
    """One row: components, the two largest sizes and how many are single nodes."""
    sizes = components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.orderBy(F.col("size").desc(), "component").limit(2).agg(F.sort_array(F.collect_list("size"), False).alias("s"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.coalesce(F.sum((F.col("size") == 1).cast("long")), F.lit(0)).alias("n_single"))
    pick = lambda k: F.coalesce(F.get("s", F.lit(k)), F.lit(0))
    return whole.crossJoin(F.broadcast(best)).select("n_components", pick(0).alias("largest"), pick(1).alias("second"), "n_single")


def clusters(graph: Graph) -> DataFrame:
    """Per class: size, edges within, degree sum, share of modularity, isolated nodes, their share and status."""
    d = degrees(graph).withColumn("class", F.coalesce("classification", "group", F.lit("Unknown")))
    per = d.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("degree_sum"), F.sum((F.col("degree") == 0).cast("long")).alias("n_isolated"), F.min("ord").alias("ord"))
    e = with_ends(graph.edges, graph.nodes.select("id", F.coalesce("classification", "group", F.lit("Unknown")).alias("class")), ("class",), "inner").where("src_class = dst_class")
    inner = e.groupBy(F.col("src_class").alias("class")).agg(F.count(F.lit(1)).alias("intra_edges"))
    m = graph.edges.agg(F.count(F.lit(1)).alias("m"))
    out = per.join(inner, "class", "left").withColumn("intra_edges", F.coalesce("intra_edges", F.lit(0))).crossJoin(F.broadcast(m))
    q = ratio(F.col("intra_edges"), F.col("m")) - F.pow(F.col("degree_sum") / F.greatest(2 * F.col("m"), F.lit(1)), 2)
    return out.select("class", "ord", "size", "intra_edges", "degree_sum", F.when(F.col("m") == 0, 0.0).otherwise(q).alias("q_share"), "n_isolated", (ratio(F.col("n_isolated"), F.col("size")) * 100).alias("isolated_pct"), bands.cluster_status(F.col("n_isolated"), F.col("size")).alias("status"))


def modularity(graph: Graph) -> DataFrame:
    """One row (q, band): modularity of the classes, within [-1, 1], 0 without edges."""
    q = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.sum("q_share"), F.lit(0.0))))
    return clusters(graph).agg(q.alias("q")).withColumn("band", bands.modularity_band(F.col("q")))


def with_neighbours(rows: DataFrame, graph: Graph, some: bool = False) -> DataFrame:
    """``rows`` (id, ord, ...) of all nodes, or of ``some``, with their neighbours' labels."""
    return with_neighbour_labels(rows, graph, some).select(*rows.columns, F.coalesce("labels", F.lit("")).alias("neighbours"))


def node_metrics(graph: Graph, convention: str = "dashboard", listed: bool = True, max_sources: int | None = DASHBOARD_SOURCES) -> DataFrame:
    """Every node with degree, dc, bc, ranks, roles, uncertainty, policy flag and, if ``listed``, neighbours; bc and what follows from it as ``betweenness`` takes ``max_sources``."""
    # written once: ranks and thresholds below read it several times
    base = materialize(degree_centrality(graph, 0.0 if convention == "dashboard" else 1.0).join(betweenness(graph, convention, max_sources).select("id", F.col("betweenness").alias("bc")), "id"), "node-metrics")
    ranked = global_rank(global_rank(base, F.round("dc", 12), "rank_dc"), F.round("bc", 12), "rank_bc")
    n = base.count()
    at = lambda share: F.coalesce(F.max(F.when(F.col("rank_bc") - 1 == int(n * share), F.round("bc", 12))), F.lit(0.0))
    cuts = ranked.agg(at(bands.KEY_RANK).alias("_high"), at(bands.SUPPORT_RANK).alias("_middle"))
    ranked = ranked.crossJoin(F.broadcast(cuts))  # one row
    metrics = ranked.select(
        "id", "ord", F.coalesce("label", "id").alias("label"), "group", "classification", "degree", "dc", "bc", "rank_dc", "rank_bc",
        bands.dominance(F.col("dc")).alias("dominance"),
        bands.interpretive_role(F.round("bc", 12), F.col("_high"), F.col("_middle")).alias("role"),
        bands.legal_uncertainty(F.col("degree"), F.col("dc"), F.col("bc")).alias("uncertainty"),
        bands.policy_flag(F.col("degree"), F.col("classification"), F.col("dc")).alias("policy"),
    )
    return with_neighbours(metrics, graph) if listed else metrics


def metrics_table(graph: Graph) -> DataFrame:
    """(metric, value, band): the dashboard's summary of a graph."""
    d = degrees(graph)
    n = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.sum((F.col("degree") == 0).cast("long")), F.lit(0)).alias("isolated"), F.count_distinct(F.coalesce("classification", "group")).alias("clusters"))
    m = graph.edges.agg(F.count(F.lit(1)).alias("m"))
    row = n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(modularity(graph)))
    density = F.col("m") / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1.0))
    each = [
        ("nodes", F.col("n"), F.lit("")),
        ("edges", F.col("m"), F.lit("")),
        ("density", density, bands.density_band(density)),
        ("average degree", F.col("avg_degree"), bands.average_degree_band(F.col("avg_degree"))),
        ("maximum degree", F.col("max_degree"), F.lit("")),
        ("isolated", F.col("isolated"), bands.isolated_band(F.col("isolated"))),
        ("coverage", ratio(F.col("n") - F.col("isolated"), F.col("n")) * 100, F.lit("")),
        ("modularity", F.col("q"), F.col("band")),
        ("clusters", F.col("clusters"), F.lit("")),
    ]
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), label.alias("band")) for name, value, label in each])).alias("x")).select("x.*")


def edge_list(graph: Graph, limit: int = 2000) -> DataFrame:
    """The first ``limit`` edges with both labels, and a row that says how many more there are."""
    first = with_ends(graph.edges.orderBy("ord").limit(limit), graph.nodes, ("label",), "left")
    rows = first.select("ord", "src", F.coalesce("src_label", "src").alias("src_label"), "dst", F.coalesce("dst_label", "dst").alias("dst_label"), F.coalesce("type", F.lit("link")).alias("type"), F.lit(None).cast("long").alias("more"))
    rest = graph.edges.agg((F.count(F.lit(1)) - limit).alias("more")).where("more > 0")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]]
    return rows.unionByName(rest.select(*blank, "more"))
