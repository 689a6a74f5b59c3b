"""Every registered query of the graph engine with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from normgraph.functions import bands, ident, tables, text, translate
from normgraph.functions import prompts as prompts_text
from normgraph.model import INCIDENT, Graph, few
from normgraph.operators import graph as g
from normgraph.operators import registry, report, tfidf
from normgraph.operators.centrality import adjacent_pairs, betweenness, betweenness_estimate, pair_dependencies
from normgraph.operators.growth import GrowingGraph
from normgraph.operators.ranking import global_rank, head, newest_first, top
from normgraph.operators.similarity import pair_percentile, pair_statistics, threshold_sweep
from normgraph.plans import pipeline
from normgraph.plans.tables import LEVELS, MASTER_SQL, NATIONS_SQL, NODES_SQL, PATHS_SQL, candidates, edges_of, master, master_nodes, nations, provisions, read, scored
from normgraph.sources import INCIDENT_SCHEMA, extract_pages, extract_texts, generate_incidents, incident_text, literal_between, localized, parse_log, read_graph, read_incidents, registry_incidents, sinks
from normgraph.storage import materialize, new_path, scoped

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (scoped(f), sql)
        return f

    return put


def r6(c):
    return F.round(c, 6)


# --- similarity edges ---------------------------------------------------------


@query("hub_top10", MASTER_SQL + " SELECT row_number() OVER (ORDER BY degree DESC, ord) AS rank, id, label, degree FROM g ORDER BY degree DESC, ord LIMIT 10")
def hub_top10(spark, d):
    return top(g.degrees(master(spark, d)), F.col("degree"), 10).select("rank", "id", "label", "degree")


def _edges(kind):
    return lambda spark, d: edges_of(spark, d, kind).select("src", "dst", "type", "weight")


for _kind, _name in (("intl", "edges_intl"), ("natl", "edges_natl"), ("cross", "edges_cross"), ("governs", "edges_governs")):
    query(_name, MASTER_SQL + f" SELECT src, dst, type, weight FROM e WHERE kind = '{_kind}'")(_edges(_kind))

_CUTS = ((0.40, "Identik"), (0.33, "Sangat Kuat"))


@query("edge_tiers", MASTER_SQL + " SELECT CASE WHEN weight >= 0.40 THEN 'Identik' WHEN weight >= 0.33 THEN 'Sangat Kuat' ELSE 'Lemah' END AS tier, count(*) AS n FROM e GROUP BY 1")
def edge_tiers(spark, d):
    return master(spark, d).edges.groupBy(bands.weight_tier(F.col("weight"), _CUTS).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("edge_orientation", MASTER_SQL + """ SELECT CASE WHEN a.year <= b.year THEN src ELSE dst END AS "from", CASE WHEN a.year <= b.year THEN dst ELSE src END AS "to", CASE WHEN a.year = b.year THEN '' ELSE 'to' END AS arrows, e.weight AS value
FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst""")
def edge_orientation(spark, d):
    return sinks.export_edges(master(spark, d)).select("from", "to", "arrows", "value")


@query("edge_labels", MASTER_SQL + """ SELECT src, dst, replace(type, '_', ' ') || ' (' || CASE WHEN weight >= 0.95 THEN 'Identik' WHEN weight >= 0.8 THEN 'Sangat Kuat' ELSE 'Lemah' END || ' ' || printf('%.1f', weight * 100) || '%)' AS label FROM e""")
def edge_labels(spark, d):
    return master(spark, d).edges.select("src", "dst", bands.edge_label(F.col("type"), F.col("weight")).alias("label"))


@query("pair_stats", MASTER_SQL + f""" SELECT CAST({LEVELS['intl']} AS DOUBLE) AS threshold, (SELECT count(*) FROM e WHERE kind = 'intl') AS kept, (SELECT count(*) FROM n a JOIN n b ON a.ord < b.ord AND a.grp <> b.grp WHERE a.side = 'intl' AND b.side = 'intl') AS candidates""")
def pair_stats(spark, d):
    return pair_statistics(provisions(spark, d).where("side = 'intl'"), edges_of(spark, d, "intl"), LEVELS["intl"])


@query("percentile_cutoff", MASTER_SQL + " SELECT round(quantile_cont(score, 0.9), 6) AS cutoff FROM p WHERE kind = 'cross'")
def percentile_cutoff(spark, d):
    """The cut-off over every candidate pair."""
    return spark.createDataFrame([(pair_percentile(candidates(spark, d, "cross"), "p90"),)], "cutoff double").select(r6("cutoff").alias("cutoff"))


_SWEEP = (0.1, 0.15, 0.2, 0.25, 0.3)


@query("similarity_sweep", MASTER_SQL + f" SELECT t AS threshold, count(*) FILTER (score > t) AS n_pairs FROM p, (SELECT CAST(unnest([{', '.join(map(str, _SWEEP))}]) AS DOUBLE) AS t) WHERE kind = 'intl' AND score >= 0.05 GROUP BY t")
def similarity_sweep(spark, d):
    return threshold_sweep(scored(spark, d, "intl", 0.05), _SWEEP)


# --- degree, density, counts --------------------------------------------------


@query("degree", MASTER_SQL + " SELECT id, degree FROM g")
def degree(spark, d):
    return g.degrees(master(spark, d)).select("id", "degree")


@query("degree_centrality", MASTER_SQL + " SELECT id, round(degree / (SELECT greatest(count(*) - 1, 1) FROM n), 6) AS dc FROM g")
def degree_centrality(spark, d):
    return g.degree_centrality(master(spark, d)).select("id", r6("dc").alias("dc"))


@query("density", MASTER_SQL + " SELECT n, m, round(2.0 * m / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM n), (SELECT count(*) AS m FROM e)")
def density(spark, d):
    return g.density(master(spark, d)).select("n", "m", r6("density").alias("density"))


@query("macro_counts", MASTER_SQL + f""" SELECT count(*) AS n_nodes, count(*) FILTER (starts_with(cls, 'Intl')) AS n_intl, count(*) FILTER (starts_with(cls, 'Natl')) AS n_natl, count(*) FILTER (grp = '{INCIDENT}') AS n_incidents,
count(*) FILTER (grp = '{INCIDENT}' AND degree > 0) AS n_covered, (SELECT count(*) FROM e) AS n_edges, round(2.0 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 6) AS density,
round(100.0 * count(*) FILTER (grp = '{INCIDENT}' AND degree > 0) / greatest(count(*) FILTER (grp = '{INCIDENT}'), 1), 6) AS coverage_pct FROM g""")
def macro_counts(spark, d):
    return report.macro_counts(master(spark, d)).withColumns({c: r6(c) for c in ("density", "coverage_pct")})


@query("group_coverage", MASTER_SQL + """ SELECT g.grp AS "group", min_by(g.cls, g.ord) AS classification, count(*) AS total, count(*) FILTER (degree > 0) AS connected, round(100.0 * count(*) FILTER (degree > 0) / count(*), 6) AS coverage_pct,
CAST(sum(degree) AS BIGINT) AS degree_sum, coalesce(any_value(c.k), 0) AS cross_edges
FROM g LEFT JOIN (SELECT a.grp, count(*) AS k FROM x JOIN n a ON a.id = x.id JOIN n b ON b.id = x.other WHERE a.grp <> b.grp GROUP BY a.grp) c ON c.grp = g.grp GROUP BY g.grp""")
def group_coverage(spark, d):
    return report.group_coverage(master(spark, d)).withColumn("coverage_pct", r6("coverage_pct"))


@query("isolated_nodes", MASTER_SQL + " SELECT id, label FROM g WHERE degree = 0")
def isolated_nodes(spark, d):
    return g.isolated(master(spark, d)).select("id", "label")


@query("connected_nodes", MASTER_SQL + " SELECT id, label FROM g WHERE degree > 0")
def connected_nodes(spark, d):
    return g.connected(master(spark, d)).select("id", "label")


@query("isolated_by_class", MASTER_SQL + " SELECT cls AS classification, count(*) AS n_isolated FROM g WHERE degree = 0 GROUP BY cls")
def isolated_by_class(spark, d):
    return report.isolated_by_class(master(spark, d))


@query("isolated_head", MASTER_SQL + """ SELECT id, CAST(NULL AS BIGINT) AS more FROM (SELECT id, ord FROM g WHERE degree = 0 ORDER BY ord LIMIT 5)
UNION ALL SELECT NULL, count(*) - 5 FROM g WHERE degree = 0 HAVING count(*) > 5""")
def isolated_head(spark, d):
    return head(g.isolated(master(spark, d)).select("id", "ord"), 5).select("id", "more")


# --- sub-graphs and contraction -----------------------------------------------


@query("subgraph_intl", MASTER_SQL + " SELECT src, dst, weight FROM e WHERE kind = 'intl'")
def subgraph_intl(spark, d):
    return g.class_subgraph(master(spark, d), "Intl:").edges.select("src", "dst", "weight")


@query("subgraph_natl_degrees", MASTER_SQL + " SELECT n.id, count(x.other) AS degree FROM n LEFT JOIN x ON x.id = n.id AND x.kind = 'natl' WHERE n.side = 'natl' GROUP BY n.id")
def subgraph_natl_degrees(spark, d):
    return g.degrees(g.class_subgraph(master(spark, d), "Natl:")).select("id", "degree")


_BARE = MASTER_SQL + ", b AS (SELECT id, grp, CASE WHEN ord % 3 > 0 THEN cls END AS cls, CASE WHEN ord % 2 = 0 THEN 'Intl: ' || grp ELSE grp END AS own FROM g)"


@query("subgraph_without_classification", _BARE + """ SELECT 'by group' AS kind, count(*) AS n_nodes, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM b WHERE starts_with(coalesce(cls, own), 'Intl:')) AND dst IN (SELECT id FROM b WHERE starts_with(coalesce(cls, own), 'Intl:'))) AS n_edges FROM b WHERE starts_with(coalesce(cls, own), 'Intl:')
UNION ALL SELECT 'by class', count(*), (SELECT count(*) FROM e WHERE src IN (SELECT id FROM b WHERE starts_with(cls, 'Intl:')) AND dst IN (SELECT id FROM b WHERE starts_with(cls, 'Intl:'))) FROM b WHERE starts_with(cls, 'Intl:')""")
def subgraph_without_classification(spark, d):
    """A third of the nodes has no classification, and goes by its group or by nothing."""
    m = master(spark, d)
    group = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Intl: "), "group")).otherwise(F.col("group"))
    bare = Graph(m.nodes.withColumns({"classification": F.when(F.col("ord") % 3 > 0, F.col("classification")), "group": group}), m.edges)
    out = None
    for kind, by_group in (("by group", True), ("by class", False)):
        part = g.class_subgraph(bare, "Intl:", by_group)
        row = part.nodes.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(part.edges.agg(F.count(F.lit(1)).alias("n_edges"))))
        out = row if out is None else out.unionByName(row)
    return out


@query("subgraph_cross", MASTER_SQL + " SELECT n.id, count(x.other) AS degree FROM n LEFT JOIN x ON x.id = n.id AND x.kind = 'cross' GROUP BY n.id")
def subgraph_cross(spark, d):
    return g.degrees(g.typed_subgraph(master(spark, d), "cross_jurisdiction")).select("id", "degree")


@query("subgraph_incident_nodes", MASTER_SQL + " SELECT DISTINCT id FROM x WHERE kind = 'governs'")
def subgraph_incident_nodes(spark, d):
    return g.endpoints(g.typed_subgraph(master(spark, d), "governs").edges)


@query("contraction", MASTER_SQL + """ SELECT CASE WHEN fa <= fb THEN ga ELSE gb END AS src, CASE WHEN fa <= fb THEN gb ELSE ga END AS dst, min_by(type, ord) AS type, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT e.type, e.ord, a.grp AS ga, b.grp AS gb, (SELECT min(ord) FROM n z WHERE z.grp = a.grp) AS fa, (SELECT min(ord) FROM n z WHERE z.grp = b.grp) AS fb FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.grp <> b.grp) GROUP BY 1, 2""")
def contraction(spark, d):
    return g.contract(master(spark, d)).edges.select("src", "dst", "type", "weight")


@query("contraction_nodes", MASTER_SQL + """ SELECT grp AS id, min_by(cls, ord) AS classification, count(*) * 5 AS value FROM n GROUP BY grp""")
def contraction_nodes(spark, d):
    return g.contract(master(spark, d)).nodes.select("id", "classification", "value")


@query("contraction_nations", """SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""")
def contraction_nations(spark, d):
    """Order lines contracted to pairs of nations: the contraction at the size of the largest table."""
    buyers = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


@query("top_pairs", NATIONS_SQL + " SELECT row_number() OVER (ORDER BY weight DESC, ord) AS rank, src, dst, weight FROM e ORDER BY weight DESC, ord LIMIT 10")
def top_pairs(spark, d):
    return top(nations(spark, d).edges, F.col("weight"), 10).select("rank", "src", "dst", "weight")


@query("side_degree_avg", MASTER_SQL + " SELECT n.id, substr(n.cls, 1, 4) AS side, count(*) AS degree, round(avg(weight), 6) AS avg_score FROM x JOIN n ON n.id = x.id WHERE kind = 'cross' GROUP BY n.id, n.cls")
def side_degree_avg(spark, d):
    return report.side_degrees(g.typed_subgraph(master(spark, d), "cross_jurisdiction")).select("id", "side", "degree", r6("avg_score").alias("avg_score"))


@query("pair_scores", MASTER_SQL + """ SELECT a.id AS a, b.id AS b, coalesce(e.weight, 0.05) AS score FROM n a JOIN n b ON b.ord = a.ord + 1 LEFT JOIN e ON (e.src = a.id AND e.dst = b.id)""")
def pair_scores(spark, d):
    n = provisions(spark, d).select("id", "ord")
    pairs = n.select(F.col("id").alias("b"), (F.col("ord") - 1).alias("ord")).join(n.withColumnRenamed("id", "a"), "ord").select("b", "a")
    return g.pair_scores(pairs, master(spark, d).edges).select("a", "b", "score")


@query("tier_distribution", MASTER_SQL + """ SELECT tier, count(weight) AS n, round(100.0 * count(weight) / greatest((SELECT count(*) FROM e WHERE kind = 'cross'), 1), 6) AS pct
FROM (SELECT unnest(['full', 'partial', 'pseudo']) AS tier) t LEFT JOIN e ON e.kind = 'cross' AND t.tier = CASE WHEN weight >= 0.35 THEN 'full' WHEN weight >= 0.30 THEN 'partial' ELSE 'pseudo' END GROUP BY tier""")
def tier_distribution(spark, d):
    return report.tier_distribution(g.typed_subgraph(master(spark, d), "cross_jurisdiction").edges, "weight", 0.35, 0.30).withColumn("pct", r6("pct"))


# --- warrants -----------------------------------------------------------------

_WARRANTS = MASTER_SQL + f""", wa AS (
  SELECT i.id AS incident, r.id AS regulation, r.cls FROM x JOIN n i ON i.id = x.id AND i.cls = '{INCIDENT}' JOIN n r ON r.id = x.other AND r.cls <> '{INCIDENT}'
), wc AS (
  SELECT n.id AS incident, CASE WHEN count(wa.regulation) = 0 THEN 'none' WHEN bool_or(starts_with(wa.cls, 'Natl')) AND bool_or(starts_with(wa.cls, 'Intl')) THEN 'both' WHEN bool_or(starts_with(wa.cls, 'Natl')) THEN 'natl' WHEN bool_or(starts_with(wa.cls, 'Intl')) THEN 'intl' ELSE 'other' END AS warrant,
    count(wa.regulation) AS n_warrants, coalesce(string_agg(DISTINCT substr(wa.cls, 1, 4), ', ' ORDER BY substr(wa.cls, 1, 4)), '') AS prefixes, any_value(n.ord) AS ord
  FROM n LEFT JOIN wa ON wa.incident = n.id WHERE n.cls = '{INCIDENT}' GROUP BY n.id
)"""


@query("warrant_classes", _WARRANTS + " SELECT incident, warrant, n_warrants, prefixes FROM wc")
def warrant_classes(spark, d):
    return report.warrant_classes(master(spark, d)).drop("ord")


@query("warrant_distribution", _WARRANTS + " SELECT k.warrant, count(wc.incident) AS n, round(100.0 * count(wc.incident) / greatest((SELECT count(*) FROM wc), 1), 6) AS pct FROM (SELECT unnest(['none', 'natl', 'intl', 'both']) AS warrant) k LEFT JOIN wc ON wc.warrant = k.warrant GROUP BY k.warrant")
def warrant_distribution(spark, d):
    return report.warrant_distribution(master(spark, d)).withColumn("pct", r6("pct"))


@query("reg_capture_top15", _WARRANTS + " SELECT row_number() OVER (ORDER BY k DESC, ord) AS rank, regulation, k AS n FROM (SELECT wa.regulation, count(*) AS k, any_value(n.ord) AS ord FROM wa JOIN n ON n.id = wa.regulation GROUP BY wa.regulation) ORDER BY k DESC, ord LIMIT 15")
def reg_capture_top15(spark, d):
    return report.captures(master(spark, d))


@query("incident_warrants_top10", _WARRANTS + " SELECT row_number() OVER (ORDER BY n_warrants DESC, ord) AS rank, incident, n_warrants, prefixes FROM wc ORDER BY n_warrants DESC, ord LIMIT 10")
def incident_warrants_top10(spark, d):
    return top(report.warrant_classes(master(spark, d)), F.col("n_warrants"), 10).select("rank", "incident", "n_warrants", "prefixes")


@query("vacuum_incidents", _WARRANTS + " SELECT incident FROM wc WHERE warrant = 'none'")
def vacuum_incidents(spark, d):
    return report.warrant_classes(master(spark, d)).where("warrant = 'none'").select("incident")


# --- components and betweenness -----------------------------------------------

_REACH = ", r(id, c) AS (SELECT id, ord FROM n UNION SELECT x.other, r.c FROM r JOIN x ON x.id = r.id JOIN n ON n.id = x.other WHERE r.c < n.ord), cc AS (SELECT id, min(c) AS component FROM r GROUP BY id)"


@query("components", MASTER_SQL + _REACH + " SELECT id, component FROM cc")
def components(spark, d):
    return report.components(master(spark, d))


_GROWN = f"""WITH RECURSIVE {NODES_SQL}, e AS (
  SELECT a.ord AS ao, b.ord AS bo, list_cosine_similarity(a.e, b.e) AS score FROM n a JOIN n b ON a.ord < b.ord AND a.grp <> b.grp WHERE list_cosine_similarity(a.e, b.e) >= {LEVELS['cross']}
), x AS (SELECT ao AS id, bo AS other FROM e UNION ALL SELECT bo, ao FROM e),
r(id, c) AS (SELECT DISTINCT id, id FROM x UNION SELECT x.other, r.c FROM r JOIN x ON x.id = r.id WHERE r.c < x.other), cc AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""


@query("edges_grown", _GROWN + " SELECT ao AS src, bo AS dst, round(score, 6) AS score, component FROM e JOIN cc ON cc.id = ao")
def edges_grown(spark, d):
    """Links between groups in a graph that takes its rows in three batches, each row with its component."""
    rows = provisions(spark, d).select("ord", "group", "vector")
    graph = GrowingGraph(spark, new_path(spark, "grown"), LEVELS["cross"])
    turn = F.pmod(F.xxhash64("ord"), F.lit(10))
    for batch in (turn < 8, turn == 8, turn == 9):
        graph.add(rows.where(batch))
    label = graph.components().select(F.col("node").alias("src"), "component")
    return graph.edges().join(few(label), "src").select("src", "dst", r6("score").alias("score"), "component")


_SUMMARY = ", z AS (SELECT component, count(*) AS size FROM cc GROUP BY component) SELECT count(*) AS n_components, max(size) AS largest, coalesce((SELECT size FROM z ORDER BY size DESC, component LIMIT 1 OFFSET 1), 0) AS second, count(*) FILTER (size = 1) AS n_single FROM z"


@query("component_summary", MASTER_SQL + _REACH + _SUMMARY)
def component_summary(spark, d):
    return report.component_summary(master(spark, d))


@query("component_summary_nations", NATIONS_SQL + _REACH + _SUMMARY)
def component_summary_nations(spark, d):
    return report.component_summary(nations(spark, d))


@query("betweenness", NATIONS_SQL + PATHS_SQL + " SELECT id, round(bc, 6) AS betweenness FROM bc")
def betweenness_batch(spark, d):
    return betweenness(nations(spark, d)).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_distributed", NATIONS_SQL + PATHS_SQL + " SELECT id, round(bc, 6) AS betweenness FROM bc")
def betweenness_distributed(spark, d):
    """The same without broadcasting the graph."""
    return betweenness(nations(spark, d), broadcast_edges=0, block_pairs=0).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_by_blocks", NATIONS_SQL + PATHS_SQL + " SELECT id, round(bc, 6) AS betweenness FROM bc")
def betweenness_by_blocks(spark, d):
    return betweenness(nations(spark, d), broadcast_edges=0).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_by_pairs", NATIONS_SQL + PATHS_SQL + " SELECT id, round(bc, 6) AS betweenness FROM bc")
def betweenness_by_pairs(spark, d):
    """From the shares of all ordered pairs of nations, searched from both ends."""
    n = nations(spark, d)
    ords, pairs = n.nodes.select("ord"), materialize(adjacent_pairs(n, False), "pairs")
    draws = materialize(ords.withColumnRenamed("ord", "s").join(F.broadcast(ords.withColumnRenamed("ord", "t")), F.col("s") != F.col("t")).withColumn("sample", F.col("s") * 1000 + F.col("t")), "draws")
    shares = pair_dependencies(pairs, draws).groupBy(F.col("node").alias("ord")).agg(F.sum("share").alias("total"))
    size = ords.agg(((F.count(F.lit(1)) - 1) * (F.count(F.lit(1)) - 2)).alias("pairs"))
    return n.nodes.join(shares, "ord", "left").crossJoin(F.broadcast(size)).select("id", r6(F.coalesce("total", F.lit(0.0)) / F.col("pairs")).alias("betweenness"))


@query("betweenness_dashboard", NATIONS_SQL + PATHS_SQL + " SELECT id, round(2 * bc, 6) AS betweenness FROM bc")
def betweenness_dashboard(spark, d):
    return betweenness(nations(spark, d), "dashboard").select("id", r6("betweenness").alias("betweenness"))


_METRICS = NATIONS_SQL + PATHS_SQL + """, mm AS (
  SELECT g.id, g.ord, g.label, g.grp, g.cls, g.degree, g.degree / (SELECT count(*) - 1 FROM n) AS dc, round(2 * bc.bc, 12) AS bc FROM g JOIN bc USING (id)
), rr AS (
  SELECT *, row_number() OVER (ORDER BY round(dc, 12) DESC, ord) AS rank_dc, row_number() OVER (ORDER BY bc DESC, ord) AS rank_bc FROM mm
), ra AS (
  SELECT *, coalesce((SELECT bc FROM rr z WHERE z.rank_bc - 1 = floor((SELECT count(*) FROM n) * 0.1)), 0) AS hi, coalesce((SELECT bc FROM rr z WHERE z.rank_bc - 1 = floor((SELECT count(*) FROM n) * 0.3)), 0) AS mid FROM rr
)"""
_ROLE = "CASE WHEN bc >= hi THEN 'KUNCI' WHEN bc >= mid THEN 'Pendukung' ELSE 'Periferal' END"
_UNCERTAIN = "CASE WHEN degree = 0 THEN 'KRITIS' WHEN dc > 0.15 AND bc < 0.01 THEN 'TINGGI' WHEN dc < 0.03 AND bc < 0.005 THEN 'SEDANG' ELSE 'RENDAH' END"
_POLICY = "CASE WHEN degree = 0 AND starts_with(cls, 'Intl:') THEN 'GAGAL ADOPSI' WHEN degree = 0 AND starts_with(cls, 'Natl:') THEN 'GAGAL KONEKSI' WHEN degree = 0 THEN 'Structural Hole' WHEN dc > 0.2 THEN 'DOMINASI LEX GENERALIS' ELSE 'Normal' END"
_DOMINANCE = "CASE WHEN dc > 0.15 THEN 'LEX GENERALIS DOMINAN' WHEN dc > 0.05 THEN 'Hub Sektoral' ELSE 'Norma Periferal' END"


@query("interpretive_roles", _METRICS + f" SELECT id, {_ROLE} AS role FROM ra")
def interpretive_roles(spark, d):
    return report.node_metrics(nations(spark, d), listed=False).select("id", "role")


@query("legal_uncertainty", _METRICS + f" SELECT id, {_UNCERTAIN} AS uncertainty FROM ra")
def legal_uncertainty(spark, d):
    return report.node_metrics(nations(spark, d), listed=False).select("id", "uncertainty")


@query("policy_flag", MASTER_SQL + f" SELECT id, {_POLICY} AS policy FROM (SELECT *, degree / (SELECT count(*) - 1 FROM n) AS dc FROM g)")
def policy_flag(spark, d):
    dc = g.degree_centrality(master(spark, d), 0.0)
    return dc.select("id", bands.policy_flag(F.col("degree"), F.col("classification"), F.col("dc")).alias("policy"))


@query("full_node_table", _METRICS + f""" SELECT id, label, grp AS "group", cls AS classification, degree, round(dc, 6) AS dc, round(bc, 6) AS bc, rank_dc, rank_bc, {_DOMINANCE} AS dominance, {_ROLE} AS role, {_UNCERTAIN} AS uncertainty, {_POLICY} AS policy,
coalesce((SELECT string_agg(n.label, ' | ' ORDER BY x.ord, n.label) FROM x JOIN n ON n.id = x.other WHERE x.id = ra.id), '') AS neighbours FROM ra""")
def full_node_table(spark, d):
    return report.node_metrics(nations(spark, d)).drop("ord").withColumns({"dc": r6("dc"), "bc": r6("bc")})


@query("top_betweenness", _METRICS + " SELECT rank_bc AS rank, id, round(bc, 6) AS bc FROM ra WHERE rank_bc <= 10")
def top_betweenness(spark, d):
    b = betweenness(nations(spark, d), "dashboard")
    return top(b, F.round("betweenness", 12), 10).select(F.col("rank"), "id", r6("betweenness").alias("bc"))


# The same on the provision network, too large for PATHS_SQL; tested against a search in plain Python.


@query("betweenness_provisions", None)
def betweenness_provisions(spark, d):
    return betweenness(master(spark, d)).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_distributed_provisions", None)
def betweenness_distributed_provisions(spark, d):
    return betweenness(master(spark, d), broadcast_edges=0, block_pairs=0).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_by_blocks_provisions", None)
def betweenness_by_blocks_provisions(spark, d):
    return betweenness(master(spark, d), broadcast_edges=0).select("id", r6("betweenness").alias("betweenness"))


@query("betweenness_estimated_provisions", None)
def betweenness_estimated_provisions(spark, d):
    """Estimates from sampled pairs, within the error that they say."""
    return betweenness_estimate(master(spark, d))


@query("betweenness_dashboard_provisions", None)
def betweenness_dashboard_provisions(spark, d):
    return betweenness(master(spark, d), "dashboard").select("id", r6("betweenness").alias("betweenness"))


@query("interpretive_roles_provisions", None)
def interpretive_roles_provisions(spark, d):
    return report.node_metrics(master(spark, d), listed=False).select("id", "role")


@query("legal_uncertainty_provisions", None)
def legal_uncertainty_provisions(spark, d):
    return report.node_metrics(master(spark, d), listed=False).select("id", "uncertainty")


@query("full_node_table_provisions", None)
def full_node_table_provisions(spark, d):
    """Ranks, roles and their cut-offs from the paths of all nodes, not of the dashboard's first ones."""
    return report.node_metrics(master(spark, d), max_sources=None).drop("ord").withColumns({"dc": r6("dc"), "bc": r6("bc")})


@query("top_betweenness_provisions", None)
def top_betweenness_provisions(spark, d):
    b = betweenness(master(spark, d), "dashboard")
    return top(b, F.round("betweenness", 12), 10).select(F.col("rank"), "id", r6("betweenness").alias("bc"))


# --- modularity and dashboard tables ------------------------------------------

_CLUSTERS = """, k AS (SELECT *, coalesce(cls, grp) AS c FROM g), m AS (SELECT count(*) AS m FROM e), cl AS (
  SELECT k.c AS class, count(*) AS size, coalesce(any_value(i.l), 0) AS intra_edges, CAST(sum(degree) AS BIGINT) AS degree_sum, count(*) FILTER (degree = 0) AS n_isolated,
    coalesce(any_value(i.l), 0) / (SELECT greatest(m, 1) FROM m) - pow(sum(degree) / (SELECT greatest(2 * m, 1) FROM m), 2) AS q
  FROM k LEFT JOIN (SELECT a.c, count(*) AS l FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst WHERE a.c = b.c GROUP BY a.c) i ON i.c = k.c GROUP BY k.c
)"""
_CLUSTER_OUT = """ SELECT class, size, intra_edges, degree_sum, round(q, 6) AS q_share, n_isolated, round(100.0 * n_isolated / size, 6) AS isolated_pct,
CASE WHEN n_isolated / size > 0.7 THEN 'KRITIS' WHEN n_isolated / size > 0.3 THEN 'PERHATIAN' ELSE 'MODERAT' END AS status FROM cl"""
_QBAND = "CASE WHEN q >= 0.4 THEN 'Tinggi' WHEN q >= 0.2 THEN 'Sedang' ELSE 'Rendah' END"


@query("cluster_table", MASTER_SQL + _CLUSTERS + _CLUSTER_OUT)
def cluster_table(spark, d):
    return report.clusters(master(spark, d)).drop("ord").withColumns({"q_share": r6("q_share"), "isolated_pct": r6("isolated_pct")})


@query("cluster_table_nations", NATIONS_SQL + _CLUSTERS + _CLUSTER_OUT)
def cluster_table_nations(spark, d):
    return report.clusters(nations(spark, d)).drop("ord").withColumns({"q_share": r6("q_share"), "isolated_pct": r6("isolated_pct")})


@query("modularity", NATIONS_SQL + _CLUSTERS + f" SELECT round(q, 6) AS q, {_QBAND} AS band FROM (SELECT sum(q) AS q FROM cl)")
def modularity(spark, d):
    return report.modularity(nations(spark, d)).withColumn("q", r6("q"))


@query("metrics_table", MASTER_SQL + _CLUSTERS + f""", s AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, (SELECT m FROM m) AS m, max(degree) AS mx, avg(degree) AS av, count(*) FILTER (degree = 0) AS iso, (SELECT sum(q) FROM cl) AS q, (SELECT count(*) FROM cl) AS k FROM g
), t AS (SELECT *, m / (n * (n - 1) / 2) AS dens FROM s)
SELECT 'nodes' AS metric, round(n, 6) AS value, '' AS band FROM t UNION ALL SELECT 'edges', m, '' FROM t
UNION ALL SELECT 'density', round(dens, 6), CASE WHEN dens < 0.01 THEN 'Sangat Jarang' WHEN dens < 0.05 THEN 'Jarang' ELSE 'Moderat' END FROM t
UNION ALL SELECT 'average degree', round(av, 6), CASE WHEN av < 2 THEN 'sparse' ELSE 'connected' END FROM t UNION ALL SELECT 'maximum degree', mx, '' FROM t
UNION ALL SELECT 'isolated', iso, CASE WHEN iso = 0 THEN 'none' WHEN iso < 5 THEN 'few' ELSE 'many' END FROM t
UNION ALL SELECT 'coverage', round(100 * (n - iso) / n, 6), '' FROM t UNION ALL SELECT 'modularity', round(q, 6), {_QBAND} FROM t UNION ALL SELECT 'clusters', k, '' FROM t""")
def metrics_table(spark, d):
    return report.metrics_table(master(spark, d)).withColumn("value", r6("value"))


@query("neighbour_labels", MASTER_SQL + " SELECT x.id, string_agg(n.label, ' | ' ORDER BY x.ord, n.label) AS labels FROM x JOIN n ON n.id = x.other GROUP BY x.id")
def neighbour_labels(spark, d):
    return g.neighbour_labels(master(spark, d))


@query("edge_list_capped", MASTER_SQL + """, f AS (SELECT * FROM e ORDER BY ord LIMIT 100)
SELECT f.src, a.label AS src_label, f.dst, b.label AS dst_label, f.type, CAST(NULL AS BIGINT) AS more FROM f JOIN n a ON a.id = f.src JOIN n b ON b.id = f.dst
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*) - 100 FROM e HAVING count(*) > 100""")
def edge_list_capped(spark, d):
    return report.edge_list(master(spark, d), 100).drop("ord")


@query("inspector", MASTER_SQL + """ SELECT g.id, g.degree, coalesce((SELECT string_agg(label, '; ' ORDER BY rn) FROM (SELECT n.label, row_number() OVER (ORDER BY x.ord, x.other) AS rn FROM x JOIN n ON n.id = x.other WHERE x.id = g.id) WHERE rn <= 5), '') AS neighbours, greatest(g.degree - 5, 0) AS more FROM g""")
def inspector(spark, d):
    return g.inspector(master(spark, d))


@query("incident_context", MASTER_SQL + f""" SELECT i.id, count(r.id) AS n_warrants, coalesce(string_agg(r.label, chr(10) ORDER BY x.ord), '') AS context
FROM n i LEFT JOIN x ON x.id = i.id LEFT JOIN n r ON r.id = x.other AND r.grp <> '{INCIDENT}' WHERE i.grp = '{INCIDENT}' GROUP BY i.id""")
def incident_context(spark, d):
    return g.incident_context(master(spark, d))


@query("thematic_union", MASTER_SQL + """ SELECT src, dst, type FROM (SELECT src, dst, type FROM e WHERE kind = 'intl' UNION ALL SELECT a.id, b.id, 'theme' FROM n a JOIN n b ON b.ord = a.ord + 1 WHERE a.side = 'intl' AND b.side = 'intl' AND a.ord % 10 = 0)""")
def thematic_union(spark, d):
    p = provisions(spark, d).select("id", "ord")
    curated = p.where("ord % 10 = 0").join(p.select(F.col("id").alias("dst"), (F.col("ord") - 1).alias("ord")), "ord").select(F.col("id").alias("src"), "dst", F.lit("theme").alias("type"), "ord")
    return g.with_thematic(g.class_subgraph(master(spark, d), "Intl:"), curated).edges.select("src", "dst", "type")


@query("hidden_flags", MASTER_SQL + " SELECT id, degree = 0 AS hidden, CASE WHEN degree = 0 THEN 'isolated' WHEN degree <= 2 THEN 'low' ELSE 'hub' END AS badge FROM g")
def hidden_flags(spark, d):
    return g.hidden_flags(master(spark, d)).select("id", "hidden", bands.connectivity(F.col("degree")).alias("badge"))


_HOLES = ", ".join("CASE WHEN starts_with(cls, 'Intl:') THEN '{}' WHEN starts_with(cls, 'Natl:') THEN '{}' ELSE '{}' END AS {}".format(*(h[k] for h in bands.HOLES), name) for k, name in enumerate(("kind", "remedy", "certainty", "policy"), 1))


@query("structural_holes", MASTER_SQL + f" SELECT id, {_HOLES} FROM g WHERE degree = 0")
def structural_holes(spark, d):
    return g.isolated(master(spark, d)).select("id", *[c.alias(n) for n, c in bands.hole(F.col("classification")).items()])


@query("palette", MASTER_SQL + """ SELECT grp AS "group", CAST((row_number() OVER (ORDER BY min(ord)) - 1) % 20 AS INTEGER) AS colour FROM n GROUP BY grp""")
def palette(spark, d):
    return g.palette(provisions(spark, d))


@query("layout_circle", NATIONS_SQL + " SELECT id, round(cos(2 * pi() * (row_number() OVER (ORDER BY ord) - 1) / (SELECT count(*) FROM n)), 6) + 0.0 AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY ord) - 1) / (SELECT count(*) FROM n)), 6) + 0.0 AS y FROM n")
def layout_circle(spark, d):
    return g.circle_layout(nations(spark, d).nodes).select("id", (r6("x") + 0.0).alias("x"), (r6("y") + 0.0).alias("y"))


@query("audit_counts", MASTER_SQL + """ SELECT 'master' AS output, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges UNION ALL SELECT 'intl', (SELECT count(*) FROM n WHERE side = 'intl'), (SELECT count(*) FROM e WHERE kind = 'intl')
UNION ALL SELECT 'cross', (SELECT count(*) FROM n), (SELECT count(*) FROM e WHERE kind = 'cross')""")
def audit_counts(spark, d):
    m = master(spark, d)
    return sinks.audit(spark, {"master": m, "intl": g.class_subgraph(m, "Intl:"), "cross": g.typed_subgraph(m, "cross_jurisdiction")})


@query("export_nodes", MASTER_SQL + """ SELECT id, label, grp AS "group", cls AS classification, 10 + 4 * degree AS value, 'Degree: ' || degree AS title, year FROM g""")
def export_nodes(spark, d):
    return sinks.export_nodes(master(spark, d)).drop("ord")


@query("csv_cells", """SELECT '"' || replace(p_name, '"', '""') || '","' || p_size || '"' AS line FROM part""")
def csv_cells(spark, d):
    return sinks.csv_lines(read(spark, d, "part").select("p_name", "p_size"))


# --- text ---------------------------------------------------------------------

_SPLIT = r"""WITH t AS (
  SELECT conv_id AS doc, string_agg('Section ' || turn || ' ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id
), h AS (
  SELECT doc, regexp_extract_all(body, '(?i)((?:Article|Art\.|Section|Principle|Paragraph|Pasal|Bab|Bagian|Ayat|Recommendation|Rec\.|Annex|Chapter|Value|Guideline)\s+\d+[A-Za-z]?)', 1) AS hs,
    regexp_split_to_array(body, '(?i)((?:Article|Art\.|Section|Principle|Paragraph|Pasal|Bab|Bagian|Ayat|Recommendation|Rec\.|Annex|Chapter|Value|Guideline)\s+\d+[A-Za-z]?)') AS bs FROM t
), u AS (SELECT doc, i, hs[i] AS head, bs[i + 1] AS body FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM h)
), c AS (
  SELECT doc, i - 1 AS ord, upper(substr(head, 1, 1)) || lower(substr(regexp_replace(head, '\s+', ' ', 'g'), 2)) AS title, regexp_replace(regexp_replace(substr(body, 1, 2000), '^\s+', ''), '\s+$', '') AS content FROM u
), r AS (SELECT doc, title, min(ord) AS ord, max_by(content, ord) AS content FROM c WHERE length(content) > 30 GROUP BY doc, title)"""


def _bodies(spark, d):
    c = read(spark, d, "conversations")
    line = F.concat(F.lit("Section "), F.col("turn").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x")).select("doc", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


def _provisions(spark, d):
    return text.split_provisions(_bodies(spark, d))


@query("provision_split", _SPLIT + " SELECT doc, ord, title, md5(content) AS content FROM r")
def provision_split(spark, d):
    return _provisions(spark, d).withColumn("content", F.md5("content"))


@query("provision_count", _SPLIT + " SELECT doc, count(*) AS n FROM r GROUP BY doc")
def provision_count(spark, d):
    return _provisions(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query("heading_set", _SPLIT + " SELECT doc, string_agg(DISTINCT title, ',' ORDER BY title) AS titles FROM r GROUP BY doc")
def heading_set(spark, d):
    return text.distinct_headings(_bodies(spark, d)).select("doc", F.array_join("titles", ",").alias("titles"))


@query("title_normalise", r"SELECT p_partkey, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS title FROM (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'Article ' ELSE 'Recommendation ' END || p_size || ' ' || trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS t FROM part)")
def title_normalise(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "ART.  ").otherwise(" rec.\n"), F.col("p_size").cast("string"), F.lit(" \t"), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", text.normalise_title(raw).alias("title"))


@query("year_from_name", r"SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '\d{4}', 0), '') AS INTEGER), 2023) AS year FROM pages")
def year_from_name(spark, d):
    return read(spark, d, "pages").select("page_id", text.year_from_name(F.col("url"), text.DEFAULT_YEAR["intl"]).alias("year"))


@query("base_name", r"SELECT page_id, replace(regexp_extract(url, '[^/]+$', 0), '.html', '') AS name FROM pages")
def base_name(spark, d):
    return read(spark, d, "pages").select("page_id", text.base_name(F.col("url"), ".html").alias("name"))


@query("class_from_path", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Intl: Binding Law' WHEN 1 THEN 'Intl: Soft Law' WHEN 2 THEN 'Intl: Sectoral Guidance' WHEN 3 THEN 'Intl: Technical Standard' ELSE 'Intl: General' END AS classification FROM customer""")
def class_from_path(spark, d):
    folders = F.array(*[F.lit(x) for x, _ in text.INTL_CLASSES], F.lit("elsewhere"))
    path = F.concat(F.lit("/data/"), F.element_at(folders, (F.col("c_custkey") % 5 + 1).cast("int")), F.lit("/"), F.col("c_name"), F.lit(".pdf"))
    return read(spark, d, "customer").select("c_custkey", text.class_from_path(path, "intl").alias("classification"))


@query("shorten_label", "SELECT doc_id, CASE WHEN length(text) > 45 THEN substr(text, 1, 45) || '...' ELSE text END AS label FROM documents")
def shorten_label(spark, d):
    return read(spark, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("label"))


# --- identifiers, translation, registry ---------------------------------------

_PLACES = "SELECT c_custkey AS k, (['Dinas Kesehatan Tulungagung', 'Pemkot Surabaya', 'Universitas Yogyakarta', 'PT Maju Jaya Abadi', 'RSUD Probolinggo', 'BPR '])[c_custkey % 6 + 1] AS place, 2020 + c_custkey % 4 AS year FROM customer"
_CODES = "CASE k % 6 WHEN 0 THEN 'DINKES-TLGAGUNG' WHEN 1 THEN 'PEMKOT-SURABAYA' WHEN 2 THEN 'UNIV-YOGYA' WHEN 3 THEN 'PT-MAJU' WHEN 4 THEN 'RSUD-PROBOLINGGO' ELSE 'BPR-UNK' END"


def _named(spark, d):
    places = F.array(*[F.lit(x) for x in ("Dinas Kesehatan Tulungagung", "Pemkot Surabaya", "Universitas Yogyakarta", "PT Maju Jaya Abadi", "RSUD Probolinggo", "BPR ")])
    c = read(spark, d, "customer")
    body = F.concat(F.lit("Serangan milik instansi "), F.element_at(places, (F.col("c_custkey") % 6 + 1).cast("int")), F.lit("."))
    return c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("incident-auto-"), F.col("c_custkey").cast("string")).alias("id"), body.alias("text"), (F.lit(2020) + F.col("c_custkey") % 4).cast("int").alias("year"), F.col("c_custkey").alias("ord"))


@query("institution_code", f"SELECT k, {_CODES} AS code FROM ({_PLACES})")
def institution_code(spark, d):
    return _named(spark, d).select("k", ident.institution_code(ident.institution(F.col("text"))).alias("code"))


@query("rename_dedupe", f"SELECT k, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS new_id FROM (SELECT k, base, row_number() OVER (PARTITION BY base ORDER BY k) AS rn FROM (SELECT k, lower({_CODES} || '-' || year) AS base FROM ({_PLACES})))")
def rename_dedupe(spark, d):
    return ident.rename_incidents(_named(spark, d)).select("k", "new_id")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


_KEYS, _VALUES = _listed(k for k, _ in tables.INCIDENT_DICTIONARY), _listed(v for _, v in tables.INCIDENT_DICTIONARY)
_PHRASE = "t"
for _k, _v in tables.SECTOR_PHRASES:
    _PHRASE = f"replace({_PHRASE}, {_quoted(_k)}, {_quoted(_v)})"


def _pick(values, by: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


@query("translate_incidents", f"""SELECT c_custkey AS k, ({_VALUES})[c_custkey % {len(tables.INCIDENT_DICTIONARY)} + 1] AS narrative,
CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS qualification,
CASE c_custkey % 2 WHEN 0 THEN 'National Civil Service Agency (BKN).' ELSE 'Health Agency ' || c_name || ' as Electronic System Operator / Government Agency.' END AS operator, c_name AS victim,
'(' || ({_VALUES})[c_custkey % {len(tables.INCIDENT_DICTIONARY)} + 1] || ')' AS nexus FROM customer""")
def translate_incidents(spark, d):
    key = _pick([k for k, _ in tables.INCIDENT_DICTIONARY], "c_custkey")
    operator = F.when(F.col("c_custkey") % 2 == 0, "Badan Kepegawaian Negara (BKN).").otherwise(F.concat(F.lit("Dinas Kesehatan "), "c_name", F.lit(" selaku Penyelenggara Sistem Elektronik / Lembaga Pemerintah.")))
    facts = F.struct(F.lit(None).cast("string").alias("subjek_pelaku"), F.col("c_name").alias("subjek_korban"), operator.alias("subjek_pse"), F.concat(F.lit("("), key, F.lit(")")).alias("nexus_kausalitas"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), key.alias("peristiwa_hukum_kronologi"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_name")).alias("kualifikasi_peristiwa"), facts.alias("pemetaan_fakta_hukum"))
    done = translate.translate_incidents(rows)
    return done.select("k", F.col("peristiwa_hukum_kronologi").alias("narrative"), F.col("kualifikasi_peristiwa").alias("qualification"), F.col("pemetaan_fakta_hukum.subjek_pse").alias("operator"), F.col("pemetaan_fakta_hukum.subjek_korban").alias("victim"), F.col("pemetaan_fakta_hukum.nexus_kausalitas").alias("nexus"))


@query("sector_phrases", f"SELECT k, {_PHRASE} AS t FROM (SELECT p_partkey AS k, ({_listed(k for k, _ in tables.SECTOR_PHRASES)})[p_partkey % {len(tables.SECTOR_PHRASES)} + 1] || ' / ' || p_name || ' / ' || ({_listed(k for k, _ in tables.SECTOR_PHRASES)})[p_size % {len(tables.SECTOR_PHRASES)} + 1] AS t FROM part)")
def sector_phrases(spark, d):
    phrases = [k for k, _ in tables.SECTOR_PHRASES]
    raw = F.concat(_pick(phrases, "p_partkey"), F.lit(" / "), "p_name", F.lit(" / "), _pick(phrases, "p_size"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), translate.sector_text(raw).alias("t"))


@query("interface_texts", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '  ' || o_orderstatus || ' ' END AS shown, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'X' ELSE '  ' || o_orderstatus || ' ' END AS back FROM orders")
def interface_texts(spark, d):
    names = {"F": "done", "O": "open", "X": "open"}
    shown = translate.interface_text(F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")), names)
    return read(spark, d, "orders").select("o_orderkey", shown.alias("shown"), translate.interface_text(shown, translate.inverse(names)).alias("back"))


@query("lookup_passthrough", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def lookup_passthrough(spark, d):
    return read(spark, d, "orders").select("o_orderkey", translate.lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("registry_search", "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND (contains(lower(coalesce(props, '')), '1') OR contains(lower(coalesce(event_type, '')), '1'))")
def registry_search(spark, d):
    return registry.search(read(spark, d, "events"), "1", ("props", "event_type"), "click", "event_type").select("event_id", "event_type")


@query("registry_search_text", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(source, '')), 'license')")
def registry_search_text(spark, d):
    return registry.search(read(spark, d, "documents"), "LICENSE", ("text", "source")).select("doc_id")


_SECTOR_KEYS = ("fintech", "facial", "ecommerce", "content", "judicial", "health")


@query("sector_status", f"""SELECT s.*, (SELECT count(*) FROM customer WHERE ({_listed(_SECTOR_KEYS)})[c_custkey % {len(_SECTOR_KEYS)} + 1] = s.sector) AS n_asked
FROM (VALUES ('fintech', 38, 1, 2, 3, 'medium'), ('facial', 22, 0, 2, 3, 'low'), ('ecommerce', 29, 1, 2, 3, 'low'), ('content', 35, 0, 3, 3, 'medium'), ('judicial', 18, 1, 1, 3, 'low')) AS s(sector, score, covered, partial, gap, band)""")
def sector_status(spark, d):
    """Cards of the sectors, each with how many customers ask for it."""
    asked = read(spark, d, "customer").groupBy(_pick(_SECTOR_KEYS, "c_custkey").alias("sector")).agg(F.count(F.lit(1)).alias("n_asked"))
    return registry.sectors(spark).drop("title").join(F.broadcast(asked), "sector", "left").withColumn("n_asked", F.coalesce("n_asked", F.lit(0)))


@query("status_counts", "SELECT toxic, count(*) FILTER (quality = 1) AS n_1, count(*) FILTER (quality = 0) AS n_0 FROM labels GROUP BY toxic")
def status_counts(spark, d):
    return registry.status_counts(read(spark, d, "labels"), "toxic", "quality", (1, 0))


_RULES = ", ".join(f"({', '.join(map(_quoted, r))}, {k})" for k, r in enumerate(tables.COMPLIANCE))
_SECTORS = _listed(("fintech", "facial", "health", "elsewhere"))


@query("compliance_rules", f"""WITH r AS (SELECT * FROM (VALUES {_RULES}) AS r(sector, status, title, desc_, recom, ord))
SELECT c_custkey, status, title, desc_ AS "desc", recom FROM (SELECT c_custkey, ({_SECTORS})[c_custkey % 4 + 1] AS s FROM customer) JOIN r ON r.sector = CASE s WHEN 'elsewhere' THEN 'other' ELSE s END""")
def compliance_rules(spark, d):
    asked = read(spark, d, "customer").select("c_custkey", _pick(("fintech", "facial", "health", "elsewhere"), "c_custkey").alias("sector"))
    return registry.navigate(asked, registry.compliance_rules(spark)).select("c_custkey", "status", "title", "desc", "recom")


@query("rule_icons", "SELECT doc_id, CASE WHEN toxic = 1 THEN '❌' WHEN quality = 1 THEN '✅' ELSE '⚠️' END AS icon FROM labels")
def rule_icons(spark, d):
    status = F.when(F.col("toxic") == 1, "gap").when(F.col("quality") == 1, "covered").otherwise("partial")
    return read(spark, d, "labels").select("doc_id", bands.status_icon(status).alias("icon"))


@query("type_badges", "SELECT c_custkey, (['Ransomware', 'Data Breach', 'AI Misuse', 'AI Fraud', 'Other'])[c_custkey % 5 + 1] AS badge FROM customer")
def type_badges(spark, d):
    return read(spark, d, "customer").select("c_custkey", bands.type_badge(_pick(("ransomware", "data_breach", "ai_misuse", "ai_fraud", "phishing"), "c_custkey")).alias("badge"))


@query("edge_colours", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size * 2 >= 95 THEN '#10b981' WHEN p_size * 2 >= 80 THEN '#f59e0b' ELSE '#f43f5e' END WHEN 1 THEN ({_listed(c for _, c in bands.THEME_COLOURS)})[p_size % 9 + 1] ELSE '{bands.PLAIN_COLOUR}' END AS cross_colour,
CASE p_partkey % 3 WHEN 1 THEN ({_listed(c for _, c in bands.THEME_COLOURS)})[p_size % 9 + 1] ELSE '{bands.PLAIN_COLOUR}' END AS other_colour FROM part""")
def edge_colours(spark, d):
    tiered = F.concat(F.lit("semantic link (Lemah "), (F.col("p_size") * 2).cast("string"), F.lit(".0%)"))
    label = F.when(F.col("p_partkey") % 3 == 0, tiered).when(F.col("p_partkey") % 3 == 1, _pick([t for t, _ in bands.THEME_COLOURS], "p_size")).otherwise("governs")
    return read(spark, d, "part").select("p_partkey", bands.edge_colour("cross", label).alias("cross_colour"), bands.edge_colour("intl", label).alias("other_colour"))


@query("label_percents", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size || '.5' AS DOUBLE) / 100 ELSE 0.05 END AS share FROM part")
def label_percents(spark, d):
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("link (Sim "), F.col("p_size").cast("string"), F.lit(".5%)"))).otherwise("link (Lemah 71.2%)")
    return read(spark, d, "part").select("p_partkey", bands.label_percent(label, bands.CROSS_DEFAULT).alias("share"))


@query("prompts", "SELECT page_id, 'Which rule covers ' || url || '?' AS prompt FROM pages")
def prompts(spark, d):
    return read(spark, d, "pages").select("page_id", registry.prompt("Which rule covers {url}?", {"url": F.col("url")}).alias("prompt"))


def _sql_prompt(template: str, fields: dict[str, str]) -> str:
    out = _quoted(template)
    for name, value in fields.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


def _sql_named(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in names.items())} ELSE {value} END"


_ASKED = ("fintech", "facial", "health", "elsewhere")
_KINDS = ("generative", "nlp", "unheard of")


@query("rule_prompts", f"""WITH r AS (
  SELECT sector, string_agg('- [' || upper(status) || '] ' || title || ': ' || desc_, chr(10) ORDER BY ord) AS rules FROM (VALUES {_RULES}) AS r(sector, status, title, desc_, recom, ord) GROUP BY sector
), c AS (SELECT c_custkey, c_name, ({_listed(_ASKED)})[c_custkey % 4 + 1] AS s, ({_listed(_KINDS)})[c_custkey % 3 + 1] AS k FROM customer)
SELECT c_custkey, {_sql_prompt(prompts_text.COMPLIANCE_PROMPT, {"sector": _sql_named("s", prompts_text.SECTOR_NAMES), "kind": _sql_named("k", prompts_text.KIND_NAMES), "rules": "rules", "description": f"CASE WHEN c_custkey % 5 = 0 THEN {_quoted(prompts_text.NO_DESCRIPTION)} ELSE c_name END"})} AS prompt
FROM c JOIN r ON r.sector = CASE s WHEN 'elsewhere' THEN 'other' ELSE s END""")
def rule_prompts(spark, d):
    """Every customer's request with the rules of its sector."""
    asked = read(spark, d, "customer").select("c_custkey", _pick(_ASKED, "c_custkey").alias("sector"), _pick(_KINDS, "c_custkey").alias("kind"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("description"))
    return registry.compliance_prompts(asked, registry.compliance_rules(spark)).select("c_custkey", "prompt")


@query("argument_prompts", MASTER_SQL + f""", w AS (
  SELECT x.id, count(*) AS n, string_agg('[' || o.label || ']: ' || o.label, chr(10) || chr(10) ORDER BY x.ord) AS regs FROM x JOIN n o ON o.id = x.other JOIN n i ON i.id = x.id WHERE i.side = 'inc' AND o.side <> 'inc' GROUP BY x.id
) SELECT n.id, {_sql_prompt(prompts_text.ARGUMENT_PROMPT, {"count": "CAST(coalesce(w.n, 0) AS VARCHAR)", "incident": "n.label", "regulations": f"coalesce(w.regs, {_quoted(prompts_text.NO_REGULATIONS)})"})} AS prompt FROM n LEFT JOIN w USING (id) WHERE n.side = 'inc'""")
def argument_prompts(spark, d):
    """Every incident of the master graph with the regulations that similarity found for it."""
    m = master(spark, d)
    found = g.incident_context(m, F.concat(F.lit("["), "label", F.lit("]: "), "label"), "\n\n")
    return registry.argument_prompts(found.join(few(m.nodes.select("id", F.col("label").alias("text"))), "id"))


@query("seed_incidents", f"""SELECT s_suppkey, t.* FROM supplier JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {', '.join(f'({_quoted(r[0])}, {_quoted(r[1])}, {_quoted(r[3][5])}, {_quoted(r[4])}, CAST({r[5]} AS INTEGER), {_quoted(r[6])})' for r in tables.SEED_INCIDENTS)}) AS t(id, narrative, nexus, severity, year, type)) AS t ON t.k = s_suppkey % {len(tables.SEED_INCIDENTS)}""".replace("t.* FROM", "t.id, t.narrative, t.nexus, t.severity, t.year, t.type FROM"))
def seed_incidents(spark, d):
    """Suppliers, each with one of the incidents that are always there."""
    first = registry_incidents(spark).where(~F.col("id").startswith("incident-auto-"))
    rows = first.select(F.col("ord").alias("k"), "id", F.col("peristiwa_hukum_kronologi").alias("narrative"), F.col("pemetaan_fakta_hukum.nexus_kausalitas").alias("nexus"), "severity", "year", "type")
    return read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(tables.SEED_INCIDENTS)).alias("k")).join(F.broadcast(rows), "k").drop("k")


@query("facts_joined", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN 'q' END, CAST(p_size AS VARCHAR), 'b', 'c', 'd', 'f') AS text FROM part")
def facts_joined(spark, d):
    given = dict(zip(INCIDENT_SCHEMA["pemetaan_fakta_hukum"].dataType.names, (F.col("p_size").cast("string"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit(None).cast("string"), F.lit("f"))))
    rows = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("peristiwa_hukum_kronologi"), F.when(F.col("p_partkey") % 2 == 0, "q").alias("kualifikasi_peristiwa"), F.struct(*[c.alias(n) for n, c in given.items()]).alias("pemetaan_fakta_hukum"))
    return rows.select("p_partkey", incident_text().alias("text"))


_LOGGED = "'[t] ERROR: ' || event_type || ' ' || event_id || chr(10) || '  Location: app:' || user_id || chr(10) || CASE WHEN event_id % 2 = 0 THEN '  Stack Trace:' || chr(10) || 'at x' || chr(10) ELSE '' END || repeat('=', 50) || chr(10)"


def _errors(spark, d):
    message = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    body = F.struct(message.alias("message"), F.lit("app").alias("source"), F.col("user_id").alias("lineno"), F.lit(7).alias("colno"), F.when(F.col("event_id") % 2 == 0, "at x").alias("stack"))
    return parse_log(read(spark, d, "events").select(F.to_json(body).alias("value")))


@query("client_errors", f"SELECT {_LOGGED} AS line FROM events")
def client_errors(spark, d):
    return sinks.log_lines(_errors(spark, d), "t")


@query("log_file", f"SELECT unnest(string_split(substr(x.line, 1, length(x.line) - 1) || chr(10), chr(10))) AS value FROM (SELECT {_LOGGED} AS line FROM events) x, range(2)")
def log_file(spark, d):
    """Two appends to a log, read back line by line."""
    path = new_path(spark, "log")
    for _ in range(2):
        sinks.append_log(_errors(spark, d), path, "t")
    return spark.read.text(path)


@query("html_escaped", "SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def html_escaped(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("html"))


@query("report_numbers", "SELECT o_orderkey, printf('%.1f', o_totalprice) AS one, printf('%.4f', o_totalprice / 7) AS four, printf('%.5f', -o_totalprice / 1000000) AS five FROM orders")
def report_numbers(spark, d):
    price = F.col("o_totalprice").cast("double")
    return read(spark, d, "orders").select("o_orderkey", text.fixed(price, 1).alias("one"), text.fixed(price / 7, 4).alias("four"), text.fixed(-price / 1000000, 5).alias("five"))


# --- what is written and read back --------------------------------------------

_GROUPED = """ SELECT CASE WHEN fa <= fb THEN ga ELSE gb END AS "from", CASE WHEN fa <= fb THEN gb ELSE ga END AS "to", 'korelasi (' || count(*) || ' edge)' AS label, '' AS arrows, count(*) AS value
FROM (SELECT a.grp AS ga, b.grp AS gb, (SELECT min(ord) FROM n z WHERE z.grp = a.grp) AS fa, (SELECT min(ord) FROM n z WHERE z.grp = b.grp) AS fb FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.grp <> b.grp) GROUP BY 1, 2"""


@query("contraction_links", MASTER_SQL + _GROUPED)
def contraction_links(spark, d):
    """The exported edges of a contraction, read back."""
    path = new_path(spark, "gap")
    sinks.write_contraction(g.contract(master(spark, d)), path)
    return spark.read.schema("`from` string, `to` string, label string, arrows string, value long").json(f"{path}/edges")


@query("contraction_groups", MASTER_SQL + """ SELECT grp AS id, grp AS label, count(*) * 5 AS value, 'Klaster: ' || min_by(cls, ord) AS title FROM n GROUP BY grp""")
def contraction_groups(spark, d):
    return sinks.export_groups(g.contract(master(spark, d))).select("id", "label", "value", "title")


@query("graph_round_trip", NATIONS_SQL + """ SELECT 'node' AS kind, id AS a, NULL AS b, CAST(10 + 4 * degree AS DOUBLE) AS value FROM g UNION ALL SELECT 'edge', src, dst, weight FROM e""")
def graph_round_trip(spark, d):
    """A graph document in a language of its own, written and read back."""
    path = new_path(spark, "document")
    document = sinks.graph_document(nations(spark, d))
    document.write.text(localized(f"{path}.json", "en"))
    back = read_graph(spark, f"{path}.json", "en")
    n = back.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("value").cast("double").alias("value"))
    return n.unionByName(back.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("value")))


@query("incidents_written", "SELECT 'case ' || event_id AS id, event_type AS type, CAST(2020 + event_id % 5 AS INTEGER) AS year FROM events WHERE event_id % 2 = 0")
def incidents_written(spark, d):
    """Incidents as one document in English, read back; those without facts are left out."""
    e = read(spark, d, "events")
    none = {f.name: F.lit(None).cast(f.dataType) for f in INCIDENT_SCHEMA.fields}
    facts = F.when(F.col("event_id") % 2 == 0, F.from_json(F.lit('{"subjek_pse": "x"}'), INCIDENT_SCHEMA["pemetaan_fakta_hukum"].dataType))
    rows = e.select(*[c.alias(n) for n, c in (none | {"id": F.concat(F.lit("case "), F.col("event_id").cast("string")), "type": F.col("event_type"), "year": (F.lit(2020) + F.col("event_id") % 5).cast("int"), "pemetaan_fakta_hukum": facts}).items()], F.col("event_id").alias("ord"))
    path = new_path(spark, "incidents")
    sinks.write_incidents(rows, localized(path, "en"))
    assert read_incidents(spark, path).isEmpty()  # there is none in the first language
    return read_incidents(spark, path, "en").select("id", "type", "year")


@query("output_audit", NATIONS_SQL + " SELECT true AS present, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges UNION ALL SELECT false, NULL, NULL")
def output_audit(spark, d):
    path = new_path(spark, "audit")
    sinks.write_graph(nations(spark, d), path)
    return sinks.audit_graphs(spark, [path, f"{path}-missing"]).drop("path")


@query("csv_sections", MASTER_SQL + """, k AS (SELECT count(*) AS n, count(DISTINCT cls) AS c, count(*) FILTER (degree = 0) AS h, (SELECT count(*) FROM e) AS m FROM g)
SELECT unnest(['metrics', 'degree', 'betweenness', 'clusters', 'holes', 'nodes', 'edges']) AS section, unnest([9, least(n, 50), least(n, 50), c, h, n, least(m, 2000) + CASE WHEN m > 2000 THEN 1 ELSE 0 END]) AS n_rows FROM k""")
def csv_sections(spark, d):
    out = None
    for name, rows in pipeline.csv_sections(master(spark, d)):
        row = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("cross_ranking", MASTER_SQL + """ SELECT row_number() OVER (PARTITION BY side ORDER BY degree DESC, first) AS rank, id, side, degree FROM (SELECT n.id, substr(n.cls, 1, 4) AS side, count(*) AS degree, min(x.ord) AS first FROM x JOIN n ON n.id = x.id WHERE kind = 'cross' GROUP BY n.id, n.cls)
QUALIFY row_number() OVER (PARTITION BY side ORDER BY degree DESC, first) <= 15""")
def cross_ranking(spark, d):
    """The best of both sides; of equal degrees the one whose first edge comes first."""
    side = materialize(report.side_degrees(g.typed_subgraph(master(spark, d), "cross_jurisdiction")), "side-degrees")
    best = [top(side.where(F.col("side") == s), F.col("degree"), 15).select("rank", "id", "side", "degree") for s in ("Intl", "Natl")]
    return best[0].unionByName(best[1])


@query("incidents_by_year", MASTER_SQL + f""" SELECT row_number() OVER (ORDER BY year DESC, ord) AS rank, id FROM n WHERE cls = '{INCIDENT}'""")
def incidents_by_year(spark, d):
    return newest_first(master_nodes(spark, d).where(F.col("classification") == INCIDENT)).select("rank", "id")


@query("explore_split", r"""WITH t AS (
  SELECT conv_id AS doc, string_agg(CASE WHEN conv_id % 2 = 0 THEN 'Section ' || turn || 'b ' ELSE chr(10) || chr(10) || turn || '. ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id
), p AS (
  SELECT *, '(?i)((?:Article|Principle|Section|Paragraph|Recommendation|Guideline)\s+\d+)' AS a, '(\n\n\d+\.\s+)' AS b FROM t
), h AS (
  SELECT doc, CASE WHEN len(regexp_extract_all(body, a, 1)) > 0 THEN regexp_extract_all(body, a, 1) ELSE regexp_extract_all(body, b, 1) END AS hs,
    CASE WHEN len(regexp_extract_all(body, a, 1)) > 0 THEN regexp_split_to_array(body, a) ELSE regexp_split_to_array(body, b) END AS bs FROM p
), u AS (SELECT doc, i, hs[i] AS head, bs[i + 1] AS body FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM h)
), c AS (
  SELECT doc, i - 1 AS ord, regexp_replace(regexp_replace(regexp_replace(head, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS title, regexp_replace(regexp_replace(substr(body, 1, 2000), '^\s+', ''), '\s+$', '') AS content FROM u
) SELECT doc, upper(substr(title, 1, 1)) || lower(substr(title, 2)) AS title, md5(max_by(content, ord)) AS content FROM c WHERE length(content) > 50 GROUP BY doc, 2""")
def explore_split(spark, d):
    c = read(spark, d, "conversations")
    head = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Section "), F.col("turn").cast("string"), F.lit("b "))).otherwise(F.concat(F.lit("\n\n"), F.col("turn").cast("string"), F.lit(". ")))
    bodies = c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("line")))).alias("x")).select("doc", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))
    return text.explore_provisions(bodies).select("doc", "title", F.md5("content").alias("content"))


# --- documents ----------------------------------------------------------------

_TURNS = """WITH t AS (
  SELECT CAST(conv_id AS VARCHAR) || '.pdf' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page, coalesce(text, '') AS text FROM conversations
)"""


def pdf_files(spark, d):
    """(path, content): conversations as PDF files with a page for each turn, shown in UTF-16 codes; they have no cross-reference."""
    turn = F.struct("turn", "role", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-16BE")).alias("codes"))
    convs = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    numbered = F.transform("turns", lambda t, k: F.concat(F.format_string("%d 0 obj <</Type /Page /Contents %d 0 R>> endobj\n%d 0 obj <<>> stream\nBT /F 1 Tf <", 10 + 2 * k, 11 + 2 * k, 11 + 2 * k), t["codes"], F.lit("> Tj ET\nendstream endobj\n")))
    kids = F.array_join(F.transform("turns", lambda t, k: F.format_string("%d 0 R", 10 + 2 * k)), " ")
    head = F.format_string("%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [%s] /Resources <</Font <</F 3 0 R>>>>>> endobj\n3 0 obj <</Type /Font /Subtype /Type0 /ToUnicode 4 0 R>> endobj\n4 0 obj <<>> stream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange\nendstream endobj\n", kids)
    return convs.select(F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), F.concat(head, F.array_join(numbered, "")).cast("binary").alias("content"))


@query("pdf_pages", _TURNS + " SELECT path, CAST(page AS INTEGER) AS page, text, false AS damaged FROM t")
def pdf_pages(spark, d):
    return extract_pages(pdf_files(spark, d))


@query("pdf_first_pages", _TURNS + " SELECT path, coalesce(string_agg(text || chr(10), '' ORDER BY page) FILTER (page <= 2 AND text <> ''), '') AS text, false AS damaged FROM t GROUP BY path")
def pdf_first_pages(spark, d):
    """Texts under a limit of two pages."""
    return extract_texts(pdf_files(spark, d), max_pages=2)


@query("literal_between", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def literal(spark, d):
    return read(spark, d, "pages").select("page_id", literal_between(F.col("html"), "<title>", "</title>").alias("title"))


def _sql_drawn(salt: int, values) -> str:
    return f"({_listed(values)})[CAST('0x' || md5('42:{salt}:' || s_suppkey)[1:8] AS BIGINT) % {len(values)} + 1]"


@query("generator", f"""WITH p AS (
  SELECT s_suppkey, {_sql_drawn(1, [a[0] for a in tables.ATTACKS])} AS type, {_sql_drawn(2, tables.INSTITUTIONS)} || ' ' || {_sql_drawn(3, tables.CITIES)} AS place, CAST({_sql_drawn(4, [str(y) for y in tables.YEARS])} AS INTEGER) AS year FROM supplier
) SELECT 'incident-auto-' || s_suppkey AS id, CASE type {' '.join(f'WHEN {_quoted(a[0])} THEN {_quoted(a[2])}' for a in tables.ATTACKS)} END || ' milik instansi ' || place || '.' AS narrative,
  'Masyarakat pengguna layanan dan pejabat ' || place || '.' AS victim, CASE type {' '.join(f'WHEN {_quoted(a[0])} THEN {_quoted(a[1])}' for a in tables.ATTACKS)} END AS severity, year, type FROM p""")
def generator(spark, d):
    """A synthetic incident for each supplier."""
    rows = generate_incidents(spark, numbers=read(spark, d, "supplier").select(F.col("s_suppkey").alias("n")))
    return rows.select("id", F.col("peristiwa_hukum_kronologi").alias("narrative"), F.col("pemetaan_fakta_hukum.subjek_korban").alias("victim"), "severity", "year", "type")


# --- TF-IDF -------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS)
_TFIDF = rf"""WITH w AS (
  SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]{{2,}}')) AS term FROM benchmark
), t AS (SELECT id, term, count(*) AS tf FROM w WHERE term NOT IN ({_STOP}) GROUP BY ALL
), f AS (SELECT term, count(*) AS df FROM t GROUP BY term
), v AS (SELECT id, t.term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM t JOIN f USING (term)
), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM v
), s AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS score FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY ALL)"""


@query("tfidf_weights", _TFIDF + " SELECT id, term, round(weight, 6) AS weight FROM u")
def tfidf_weights(spark, d):
    return tfidf.tfidf(read(spark, d, "benchmark"), "item_id", "text").withColumn("weight", r6("weight"))


@query("tfidf_sweep", _TFIDF + " SELECT t AS threshold, count(*) FILTER (score > t) AS n_pairs FROM s, (SELECT CAST(unnest([0.05, 0.08, 0.1, 0.15, 0.2]) AS DOUBLE) AS t) GROUP BY t")
def tfidf_sweep(spark, d):
    weights = tfidf.tfidf(read(spark, d, "benchmark"), "item_id", "text")
    return threshold_sweep(tfidf.term_pairs(weights, min(tfidf.SWEEP)), tfidf.SWEEP)


# All documents, too many pairs for SQL; tested by brute force.


@query("tfidf_weights_documents", None)
def tfidf_weights_documents(spark, d):
    return tfidf.tfidf(read(spark, d, "documents"), "doc_id", "text").withColumn("weight", r6("weight"))


@query("tfidf_sweep_documents", None)
def tfidf_sweep_documents(spark, d):
    """Pairs of documents whose names, source and id, differ in their prefix."""
    docs = read(spark, d, "documents")
    name = F.concat_ws("_", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    return tfidf.document_sweep(docs, "text", tfidf.document_prefix(name))


@query("document_prefix", "SELECT c_custkey, split_part(substr('a' || (c_custkey % 3) || '_' || c_name, 1, 15), '_', 1) AS prefix FROM customer")
def document_prefix(spark, d):
    name = F.concat(F.lit("a"), (F.col("c_custkey") % 3).cast("string"), F.lit("_"), F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", tfidf.document_prefix(name).alias("prefix"))


@query("global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def ranks(spark, d):
    """All orders ranked by price without gathering them in one task."""
    return global_rank(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), tie="o_orderkey").select("o_orderkey", "rank")


@query("simple_graph", NATIONS_SQL + " SELECT src, dst, weight FROM e")
def simple_graph(spark, d):
    """Reversed and repeated edges fold back into one edge each."""
    n = nations(spark, d)
    twice = n.edges.unionByName(n.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight", (F.col("ord") + 10**6).alias("ord")))
    return Graph(n.nodes, twice).simple().edges.select("src", "dst", "weight")
