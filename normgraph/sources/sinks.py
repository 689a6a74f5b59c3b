"""Writers: graph JSON, CSV sections, Markdown tables, incident JSON, logs, and an audit of outputs."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions import bands
from normgraph.model import Graph
from normgraph.operators.graph import degrees, with_ends
from normgraph.operators.ranking import global_rank
from normgraph.sources import exists
from normgraph.storage import materialize

#: Nodes and edges of a graph that one document may hold.
DOCUMENT_ROWS = 1_000_000
#: Incidents of a document where there are several.
PART_ROWS = 50_000
#: Code points that mark a UTF-8 file for spreadsheets.
BOM = "﻿"


def export_nodes(graph: Graph, title: str = "Degree") -> DataFrame:
    d = degrees(graph)
    return d.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("group", F.lit("Unknown")).alias("group"), F.coalesce("classification", "group", F.lit("Unknown")).alias("classification"), (10 + 4 * F.col("degree")).cast("long").alias("value"), F.concat(F.lit(f"{title}: "), F.col("degree").cast("string")).alias("title"), "year", "ord")


def export_edges(graph: Graph, chronological: bool = True) -> DataFrame:
    """from, to, label, arrows, value; older to newer, or source order with an arrow."""
    e = with_ends(graph.edges, graph.nodes, ("year",), "left")
    way = bands.orientation(F.col("src"), F.col("dst"), F.col("src_year"), F.col("dst_year")) if chronological else {"from": F.col("src"), "to": F.col("dst"), "arrows": F.lit("to")}
    return e.select(*[c.alias(n) for n, c in way.items()], bands.edge_label(F.col("type"), F.coalesce("weight", F.lit(0.0))).alias("label"), F.col("weight").alias("value"), "ord")


def export_groups(graph: Graph) -> DataFrame:
    """Nodes of a contraction: value is five times a group's nodes."""
    return graph.nodes.select("id", F.coalesce("label", "id").alias("label"), "group", "classification", F.col("value").cast("long").alias("value"), F.concat(F.lit("Klaster: "), F.coalesce("classification", F.lit(""))).alias("title"), "ord")


def export_links(graph: Graph) -> DataFrame:
    """Edges of a contraction: how many edges they stand for, without an arrow."""
    n = F.coalesce(F.col("weight"), F.lit(1.0)).cast("long")
    return graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.concat(F.lit("korelasi ("), n.cast("string"), F.lit(" edge)")).alias("label"), F.lit("").alias("arrows"), n.alias("value"), "ord")


def write_contraction(graph: Graph, path: str) -> None:
    """The contraction of a graph as line-wise JSON, as ``write_graph`` writes graphs."""
    export_groups(graph).orderBy("ord").drop("ord").write.mode("overwrite").json(f"{path}/nodes")
    export_links(graph).orderBy("ord").drop("ord").write.mode("overwrite").json(f"{path}/edges")


def write_graph(graph: Graph, path: str, title: str = "Degree", chronological: bool = True) -> None:
    """Nodes and edges as line-wise JSON in source order, in two folders below ``path``.

    A graph may be larger than one document could hold; ``graph_document`` makes
    the single document of a small one.
    """
    export_nodes(graph, title).orderBy("ord").drop("ord").write.mode("overwrite").json(f"{path}/nodes")
    export_edges(graph, chronological).orderBy("ord").drop("ord").write.mode("overwrite").json(f"{path}/edges")


def graph_document(graph: Graph, title: str = "Degree", chronological: bool = True) -> DataFrame:
    """One row (value): the JSON document {nodes, edges} of a graph of report size; a larger one is an error."""
    size = graph.nodes.count() + graph.edges.count()
    if size > DOCUMENT_ROWS:
        raise ValueError(f"{size} nodes and edges are too many for one document: use write_graph")
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c != "ord"]).alias("x")))).alias("a")).select(F.transform("a", lambda r: r["x"]).alias("a"))
    n, e = listed(export_nodes(graph, title)), listed(export_edges(graph, chronological))
    return n.select(F.col("a").alias("nodes")).crossJoin(e.select(F.col("a").alias("edges"))).select(F.to_json(F.struct("nodes", "edges")).alias("value"))


def csv_cell(c: Column) -> Column:
    """Quoted, with quotes doubled; null is an empty cell."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("line"))


def write_csv_sections(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """One folder per section, every cell quoted, with a header."""
    for k, (name, df) in enumerate(sections):
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/{k:02d}-{name}")


def csv_report(sections: list[tuple[str, DataFrame]]) -> Iterator[str]:
    """Lines of all sections in one file; rows stream to the driver partition by partition."""
    first = True
    for name, df in sections:
        yield (BOM if first else "") + f'"=== {name} ==="'
        first = False
        yield ",".join(f'"{c}"' for c in df.columns)
        for r in csv_lines(df).toLocalIterator():
            yield r.line
        yield ""


def markdown_table(df: DataFrame, limit: int = 50) -> list[str]:
    """A report table of at most ``limit`` rows, and a line that says how many more there are."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:limit]]
    if len(rows) > limit:
        lines.append(f"| +{df.count() - limit} more |" + " |" * (len(df.columns) - 1))
    return lines


def markdown_report(title: str, tables: list[tuple[str, DataFrame]], limit: int = 50) -> str:
    lines = [f"# {title}", ""]
    for name, df in tables:
        lines += [f"## {name}", "", *markdown_table(df, limit), ""]
    return "\n".join(lines)


def log_lines(records: DataFrame, stamp: str) -> DataFrame:
    """(line): formatted error records; source and stack only where there are any."""
    at = F.concat(F.lit("  Location: "), F.col("source"), F.lit(":"), F.coalesce(F.col("lineno").cast("string"), F.lit("")))
    some = lambda c, x: F.when(F.coalesce(F.col(c), F.lit("")) != "", x)
    head = F.concat(F.lit(f"[{stamp}] ERROR: "), F.coalesce("message", F.lit("Unknown Error")))
    return records.select(F.concat_ws("\n", head, some("source", at), some("stack", F.concat(F.lit("  Stack Trace:\n"), "stack")), F.lit("=" * 50), F.lit("")).alias("line"))


def append_log(records: DataFrame, path: str, stamp: str) -> None:
    log_lines(records, stamp).withColumnRenamed("line", "value").write.mode("append").text(path)


def incident_document(incidents: DataFrame) -> DataFrame:
    """One row (value): the JSON document {incidents} in source order, as ``read_incidents`` reads it."""
    n = incidents.count()
    if n > DOCUMENT_ROWS:
        raise ValueError(f"{n} incidents are too many for one document")
    row = F.struct(*[c for c in incidents.columns if c != "ord"])
    listed = incidents.agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("x")))).alias("a"))
    return listed.select(F.to_json(F.struct(F.transform("a", lambda r: r["x"]).alias("incidents"))).alias("value"))


def write_incidents(incidents: DataFrame, path: str) -> None:
    """One document, or of more incidents than one may hold several, a file each, with the place of its first one (``first``)."""
    if incidents.limit(DOCUMENT_ROWS + 1).count() <= DOCUMENT_ROWS:
        incident_document(incidents).coalesce(1).write.mode("overwrite").text(path)
        return
    names = [c for c in incidents.columns if c != "ord"]
    place = F.col("_nth") - 1
    ranked = global_rank(incidents.withColumn("_all", F.lit(0)), F.col("_all"), "_nth").select((place - place % PART_ROWS).alias("first"), F.struct(place.alias("place"), F.struct(*names).alias("x")).alias("row"))
    listed = ranked.groupBy("first").agg(F.array_sort(F.collect_list("row")).alias("a"))
    documents = listed.select(F.to_json(F.struct("first", F.transform("a", lambda r: r["x"]).alias("incidents"))).alias("value"))
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def audit(spark: SparkSession, graphs: dict[str, Graph]) -> DataFrame:
    """(output, n_nodes, n_edges) of each graph."""
    out = None
    for name, g in graphs.items():
        row = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))).select(F.lit(name).alias("output"), "n_nodes", "n_edges")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "output string, n_nodes long, n_edges long")


def audit_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, present, bytes) of expected outputs; a folder's size is that of all it holds."""
    rows = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        there = exists(spark, p)
        rows.append((p, there, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() if there else None))
    return spark.createDataFrame(rows, "path string, present boolean, bytes long")


def audit_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, present, n_nodes, n_edges) of written graphs, counted in what was written."""
    out = None
    for p in paths:
        there = exists(spark, f"{p}/nodes") and exists(spark, f"{p}/edges")
        counts = [spark.read.text(f"{p}/{part}").count() if there else None for part in ("nodes", "edges")]
        row = spark.createDataFrame([(p, there, *counts)], "path string, present boolean, n_nodes long, n_edges long")
        out = row if out is None else out.unionByName(row)
    return out


MANIFEST = "_manifest"


def _rename(spark: SparkSession, old: str, new: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path
    files = where(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(where(old), where(new)):
        raise OSError(f"{old} can't become {new}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, by path inside it, but for the manifest and hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", F.lit(f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/"), 2), 2)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("path").startswith(f"{MANIFEST}/"))


@contextlib.contextmanager
def published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder beside ``folder`` to write all outputs to; at a good end it takes its place, with a manifest.

    Until then the former outputs stay as they are, whatever happens.  They are
    put aside for the moment of the exchange; a driver that dies in it leaves
    them there, and the next run puts them back first.
    """
    folder = folder.rstrip("/")
    staged, aside = f"{folder}.staged-{uuid.uuid4().hex}", f"{folder}.former"
    if exists(spark, aside):
        if exists(spark, folder):
            _delete(spark, aside)
        else:
            _rename(spark, aside, folder)
    try:
        yield staged
        materialize(file_digests(spark, staged), "manifest").coalesce(1).write.json(f"{staged}/{MANIFEST}")
    except BaseException:
        _delete(spark, staged)
        raise
    had = exists(spark, folder)
    if had:
        _rename(spark, folder, aside)
    try:
        _rename(spark, staged, folder)
    except BaseException:
        if had:
            _rename(spark, aside, folder)
        raise
    if had:
        _delete(spark, aside)


def audit_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, state): ``intact``, ``changed`` or ``missing`` files of a published folder, and ``unlisted`` ones."""
    listed = spark.read.schema("path string, bytes long, sha256 string").json(f"{folder}/{MANIFEST}")
    there = file_digests(spark, folder).select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    state = F.when(F.col("_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") == F.col("_sha256"), "intact").otherwise("changed")
    return listed.join(there, "path", "full").select("path", F.coalesce("_bytes", "bytes").alias("bytes"), state.alias("state"))
