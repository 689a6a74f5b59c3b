"""The driver tables in the roles of the engine's inputs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.model import INCIDENT, Graph
from normgraph.operators.similarity import Pairs, similar_pairs
from normgraph.plans.pipeline import in_order
from normgraph.storage import materialize, scope, settled, written

#: Thresholds on these vectors, whose largest cosine is about 0.5.
LEVELS = {"intl": 0.30, "natl": 0.30, "cross": 0.28, "governs": 0.25}
KINDS = ("intl", "natl", "cross", "governs")
TYPES = {"intl": "semantic_link", "natl": "semantic_link", "cross": "cross_jurisdiction", "governs": "governs"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as provisions: labels 0-3 international, 4-7 national, 8-9 incidents."""
    side = F.when(F.col("label") <= 3, "intl").when(F.col("label") <= 7, "natl").otherwise("inc")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), "label", "embedding").withColumn("side", side)
    cls = F.when(F.col("side") == "intl", F.concat(F.lit("Intl: "), F.col("label").cast("string"))).when(F.col("side") == "natl", F.concat(F.lit("Natl: "), F.col("label").cast("string"))).otherwise(INCIDENT)
    group = F.when(F.col("side") == "inc", INCIDENT).otherwise(F.concat(F.lit("doc"), F.col("label").cast("string")))
    return rows.select("id", "ord", F.concat(F.lit("P "), F.col("id")).alias("label"), group.alias("group"), cls.alias("classification"), (F.lit(2000) + F.col("ord") % 25).cast("int").alias("year"), "side", F.col("embedding").alias("vector"))


def candidates(spark: SparkSession, sf_dir: str, kind: str, threshold: float | None = None) -> Pairs:
    """The pairs of one of the four kinds."""
    p = provisions(spark, sf_dir)
    t = LEVELS[kind] if threshold is None else threshold
    if kind in ("intl", "natl"):
        return Pairs(p.where(F.col("side") == kind), t)
    if kind == "cross":
        return Pairs(p.where("side = 'intl'"), t, p.where("side = 'natl'"))
    return Pairs(p.where("side <> 'inc'"), t, p.where("side = 'inc'"), cross_group=False)


def scored(spark: SparkSession, sf_dir: str, kind: str, threshold: float | None = None) -> DataFrame:
    """(src, dst, score) of one of the four kinds of pairs, by ord."""
    return similar_pairs(candidates(spark, sf_dir, kind, threshold))


def edges_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Edges of one kind; place orders them by kind, then by their ends."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return scored(spark, sf_dir, kind).select(a.cast("string").alias("src"), b.cast("string").alias("dst"), F.lit(TYPES[kind]).alias("type"), F.round("score", 4).alias("weight"), F.struct(F.lit(KINDS.index(kind)).alias("kind"), a.alias("a"), b.alias("b")).alias("place"))


_graphs: dict[tuple, tuple[Graph, tuple, set[str]]] = {}
_making = threading.RLock()


def _state(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """What tells a table's files of one moment from those of another: their paths, sizes and times, in folders of any depth."""
    found = []
    for t in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files, here = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
        while files.hasNext():
            f = files.next()
            here.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        found += sorted(here)
    return tuple(found)


def _shared(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make) -> Graph:
    """``make()``'s graph, kept while the tables' files stay the same and its own tables are there; one thread makes it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _making:
        state = _state(spark, sf_dir, tables)
        if key in _graphs:
            graph, had, paths = _graphs[key]
            if had == state and paths <= written(spark):
                return graph
        with scope(spark, lasting=True) as own:
            graph = make()
            paths = set(own.paths)
        _graphs[key] = graph, state, paths
        return graph


#: Bits of an end's ord in a packed place.
END_BITS = 30


def packed_edges(spark: SparkSession, edges: DataFrame, low: int, high: int) -> DataFrame:
    """Edges of ``edges_of``, written as numbers where they are found; ord is their place (kind, a, b) in one number, and they bring a and b.

    Very many edges are then never dealt again for their order.  Nodes' ords
    between ``low`` and ``high`` that don't fit are ranked instead.
    """
    if low < 0 or high >= 1 << END_BITS:
        return settled(spark, "master-edges", lambda: in_order(edges))
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    rows = settled(spark, "master-edges", lambda: edges.select(F.col("place.kind").cast("tinyint").alias("kind"), F.col("place.a").cast("int").alias("a"), F.col("place.b").cast("int").alias("b"), "weight"), "zstd")
    types = F.element_at(F.array(*[F.lit(TYPES[k]) for k in KINDS]), kind + 1)
    place = F.shiftleft(kind.cast("long"), 2 * END_BITS).bitwiseOR(F.shiftleft(a.cast("long"), END_BITS)).bitwiseOR(b.cast("long"))
    return rows.select(a.cast("string").alias("src"), b.cast("string").alias("dst"), types.alias("type"), "weight", place.alias("ord"), a.cast("long").alias("a"), b.cast("long").alias("b"))


def master_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of ``master``, for what needs no edges."""
    return provisions(spark, sf_dir).drop("side", "vector")


def master(spark: SparkSession, sf_dir: str) -> Graph:
    """The similarity graph of all provisions; queries of one session share its edges."""

    def make() -> Graph:
        edges = None
        for kind in KINDS:
            e = edges_of(spark, sf_dir, kind)
            edges = e if edges is None else edges.unionByName(e)
        nodes = master_nodes(spark, sf_dir)
        low, high = nodes.agg(F.coalesce(F.min("ord"), F.lit(0)), F.coalesce(F.max("ord"), F.lit(0))).first()
        return Graph(nodes, packed_edges(spark, edges, low, high))

    return _shared(spark, sf_dir, "master", ("embeddings",), make)


#: Share of the mean weight from which a pair of nations is an edge.
NATION_CUT = 1.2


def _trade(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("label"), F.col("r_name").alias("group"), F.col("r_name").alias("classification"), F.lit(2000).alias("year"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    both = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    w = both.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    w = materialize(w, "nation-pairs")
    strong = w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).where(F.col("w") >= F.col("mean") * NATION_CUT)
    name = nodes.select("id", "ord")
    e = strong.join(name.withColumnsRenamed({"id": "src", "ord": "a"}), "a").join(name.withColumnsRenamed({"id": "dst", "ord": "b"}), "b")
    return Graph(nodes, materialize(in_order(e.select("src", "dst", F.lit("trade").alias("type"), F.col("w").cast("double").alias("weight"), F.struct("a", "b").alias("place"))), "nation-edges"))


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations joined by how many order lines run between them."""
    return _shared(spark, sf_dir, "nations", ("nation", "region", "lineitem", "orders", "customer", "supplier"), lambda: _trade(spark, sf_dir))


# The same inputs in SQL.
_SIDE = "CASE WHEN label <= 3 THEN 'intl' WHEN label <= 7 THEN 'natl' ELSE 'inc' END"
NODES_SQL = f"""
n AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS ord, 'P ' || vec_id AS label, {_SIDE} AS side, CAST(embedding AS DOUBLE[]) AS e,
    CASE WHEN label > 7 THEN '{INCIDENT}' ELSE 'doc' || label END AS grp,
    CASE WHEN label <= 3 THEN 'Intl: ' || label WHEN label <= 7 THEN 'Natl: ' || label ELSE '{INCIDENT}' END AS cls,
    CAST(2000 + vec_id % 25 AS INTEGER) AS year
  FROM embeddings
)"""
EDGES_SQL = f"""
p AS (
  SELECT a.ord AS ao, b.ord AS bo, list_cosine_similarity(a.e, b.e) AS score,
    CASE WHEN a.side = 'inc' OR b.side = 'inc' THEN 'governs' WHEN a.side = b.side THEN a.side ELSE 'cross' END AS kind
  FROM n a JOIN n b ON a.ord < b.ord AND NOT (a.side = 'inc' AND b.side = 'inc') AND (a.side = 'inc' OR b.side = 'inc' OR a.grp <> b.grp)
), e AS (
  SELECT CAST(ao AS VARCHAR) AS src, CAST(bo AS VARCHAR) AS dst, CASE kind WHEN 'cross' THEN 'cross_jurisdiction' WHEN 'governs' THEN 'governs' ELSE 'semantic_link' END AS type,
    kind, score, round(score, 4) AS weight,
    CASE kind WHEN 'intl' THEN 0 WHEN 'natl' THEN 1 WHEN 'cross' THEN 2 ELSE 3 END * {10**14} + ao * {10**7} + bo AS ord
  FROM p WHERE score >= CASE kind WHEN 'cross' THEN {LEVELS['cross']} WHEN 'governs' THEN {LEVELS['governs']} ELSE {LEVELS['intl']} END
), x AS (
  SELECT src AS id, dst AS other, type, kind, weight, ord FROM e UNION ALL SELECT dst, src, type, kind, weight, ord FROM e
), g AS (
  SELECT n.id, n.ord, n.label, n.side, n.grp, n.cls, n.year, coalesce(d.degree, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS degree FROM x GROUP BY id) d USING (id)
)"""
MASTER_SQL = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
NATIONS_SQL = f"""WITH RECURSIVE n AS (
  SELECT n_name AS id, n_nationkey AS ord, n_name AS label, r_name AS grp, r_name AS cls FROM nation JOIN region ON n_regionkey = r_regionkey
), w AS (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
), e AS (
  SELECT s.id AS src, t.id AS dst, CAST(w AS DOUBLE) AS weight, a * 1000 + b AS ord FROM w JOIN n s ON s.ord = a JOIN n t ON t.ord = b WHERE w >= (SELECT avg(w) FROM w) * {NATION_CUT}
), x AS (
  SELECT src AS id, dst AS other, weight, ord FROM e UNION ALL SELECT dst, src, weight, ord FROM e
), g AS (
  SELECT n.*, coalesce(d.degree, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS degree FROM x GROUP BY id) d USING (id)
)"""
#: All shortest paths (s, v, d, sig), and from them betweenness of each node.
PATHS_SQL = """, q(s, v, d, sig) USING KEY (s, v) AS (
  SELECT id, id, 0, CAST(1 AS DOUBLE) FROM n
  UNION
  SELECT q.s, x.other, min(q.d) + 1, sum(q.sig) FROM q JOIN x ON x.id = q.v LEFT JOIN recurring.q r ON r.s = q.s AND r.v = x.other WHERE r.s IS NULL GROUP BY q.s, x.other
), bc AS (
  SELECT n.id, coalesce(sum(a.sig * b.sig / t.sig), 0) / (SELECT (count(*) - 1) * (count(*) - 2) / 2 FROM n) AS bc
  FROM n LEFT JOIN (q a JOIN q b ON a.v = b.v AND a.s < b.s AND a.s <> a.v AND b.s <> b.v JOIN q t ON t.s = a.s AND t.v = b.s AND a.d + b.d = t.d) ON a.v = n.id
  GROUP BY n.id
)"""
