"""Readers: graph JSON, incident JSON, document folders, literals, generated rows, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normgraph.functions.tables import ATTACKS, CITIES, INSTITUTIONS, SEED_INCIDENTS, YEARS
from normgraph.functions.text import DEFAULT_YEAR, base_name, class_from_path, node_id, split_provisions, year_from_name
from normgraph.model import Graph
from normgraph.sources.pdf import page_texts

INCIDENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("peristiwa_hukum_kronologi", T.StringType()),
    T.StructField("kualifikasi_peristiwa", T.StringType()),
    T.StructField("pemetaan_fakta_hukum", T.StructType([T.StructField(n, T.StringType()) for n in ("subjek_pelaku", "subjek_korban", "subjek_pse", "objek_hukum", "akibat_hukum", "nexus_kausalitas")])),
    T.StructField("severity", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("type", T.StringType()),
])
GRAPH_SCHEMA = "nodes array<struct<id string, label string, `group` string, classification string, value bigint, title string, year int>>, edges array<struct<`from` string, `to` string, label string, arrows string, type string, value double>>"
LOG_SCHEMA = "message string, source string, lineno int, colno int, stack string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def localized(path: str, lang: str = "") -> str:
    """The path of a document, graph or report in a language: its suffix comes before the extension."""
    stem, dot, kind = path.rpartition(".")
    return path if not lang else f"{stem}_{lang}.{kind}" if dot and "/" not in kind else f"{path}_{lang}"


def read_graph(spark: SparkSession, path: str, lang: str = "") -> Graph:
    """A graph document, by language suffix; places in its arrays become ord, edges keep their label and value."""
    path = localized(path, lang)
    doc = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.id", F.col("ord").cast("long").alias("ord"), F.coalesce("n.label", "n.id").alias("label"), "n.group", "n.classification", "n.year", "n.value", "n.title")
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.type", "e.label").alias("type"), F.col("e.value").alias("weight"), F.col("ord").cast("long").alias("ord"), "e.label", "e.arrows")
    return Graph(nodes, edges)


def read_incidents(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """Incidents of a document, or of a folder's documents, by language suffix; a missing file gives none, rows without facts are left out."""
    path = localized(path, lang)
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*INCIDENT_SCHEMA.fields, T.StructField("ord", T.LongType())]))
    doc = spark.read.schema(T.StructType([T.StructField("first", T.LongType()), T.StructField("incidents", T.ArrayType(INCIDENT_SCHEMA))])).option("multiLine", True).json(path)
    rows = doc.select("first", F.posexplode("incidents").alias("ord", "i")).select("i.*", (F.coalesce("first", F.lit(0).cast("long")) + F.col("ord")).alias("ord"))
    return rows.where(F.col("pemetaan_fakta_hukum").isNotNull())


def read_report(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """(ord, line): the lines of a Markdown report, by language suffix."""
    whole = spark.read.option("wholetext", True).text(localized(path, lang))
    return whole.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("ord", "line"))


def incident_text(facts: str = "pemetaan_fakta_hukum") -> Column:
    """Narrative, qualification and facts in one text."""
    fields = [F.col(f"{facts}.{f.name}") for f in INCIDENT_SCHEMA[facts].dataType.fields]
    return F.concat_ws(" ", "peristiwa_hukum_kronologi", "kualifikasi_peristiwa", *fields)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files in a folder tree."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def document_pages(content: bytes, max_pages: int | None = None) -> Iterator[str | None]:
    """Default extractor: the pages of a PDF file, or of UTF-8 text at form feeds; None for a damaged page.

    No more than ``max_pages`` are read.
    """
    if content[:1024].lstrip().startswith(b"%PDF"):
        yield from page_texts(content, max_pages)
    else:
        yield from content.decode("utf-8").split("\f")[:max_pages]


def extract_pages(files: DataFrame, extractor: Callable[[bytes, int | None], Iterable[str | None]] = document_pages, max_pages: int | None = None) -> DataFrame:
    """(path, page, text, damaged), a row for each page from 1 on, as it is read.

    A damaged page has an empty text; where a file can't be read any further a
    damaged row stands for the rest of it (page 1 if it can't be read at all).
    A null content counts as damaged, an empty file has one empty page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column(1)):
                rows: list[tuple[int, str, bool]] = []
                for row in _pages(content.as_py(), extractor, max_pages):
                    rows.append(row)
                    if len(rows) >= PAGES_AT_ONCE:
                        yield _page_rows(batch.column(0), k, rows)
                        rows = []
                if rows:
                    yield _page_rows(batch.column(0), k, rows)

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, damaged boolean")


#: Pages that are handed on together.
PAGES_AT_ONCE = 64


def _pages(content: bytes | None, extractor: Callable, max_pages: int | None) -> Iterator[tuple[int, str, bool]]:
    number = 0
    try:
        for text in extractor(content, max_pages):
            number += 1
            yield number, text or "", text is None
    except ImportError:
        raise  # no way to read such files: this must not pass for empty texts
    except Exception:  # a damaged file costs its own provisions, not the job
        yield number + 1, "", True


def _page_rows(paths: pa.Array, k: int, rows: list[tuple[int, str, bool]]) -> pa.RecordBatch:
    page, text, damaged = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([paths[k].as_py()] * len(rows), pa.string()), pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(damaged, pa.bool_())], names=["path", "page", "text", "damaged"])


def extract_texts(files: DataFrame, extractor: Callable[[bytes, int | None], Iterable[str | None]] = document_pages, max_pages: int | None = None) -> DataFrame:
    """(path, text, damaged): non-empty pages, each followed by a line end.

    A file that the extractor fails on, at the start or later on, is marked as
    damaged and has the pages before; so is one with a damaged page, which has
    all others.  Without a way to read such files at all the job fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, damaged = [], []
            for content in batch.column(1):
                pages = list(_pages(content.as_py(), extractor, max_pages))
                texts.append("".join(t + "\n" for _, t, _ in pages if t))
                damaged.append(any(d for _, _, d in pages))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(damaged, pa.bool_())], names=["path", "text", "damaged"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, damaged boolean")


def corpus_from_texts(texts: DataFrame, side: str, prefix: str = "") -> DataFrame:
    """(id, ord, label, group, classification, year, text) of the provisions of (path, text) rows, in path order."""
    named = texts.withColumn("doc", base_name(F.col("path")))
    facts = named.select("path", "doc", class_from_path(F.col("path"), side).alias("classification"), year_from_name(F.col("doc"), DEFAULT_YEAR[side]).alias("year"))
    rows = split_provisions(named.select(F.col("path").alias("doc"), "text")).withColumnRenamed("doc", "path").join(facts, "path")
    from normgraph.operators.ranking import global_rank

    ordered = rows.withColumn("_key", F.struct("path", "ord"))
    ranked = global_rank(ordered.withColumn("_zero", F.lit(0)), F.col("_zero"), "_nth", "_key")
    return ranked.select(node_id(F.col("doc"), F.col("title"), prefix).alias("id"), (F.col("_nth") - 1).alias("ord"), F.concat_ws(" - ", "doc", "title").alias("label"), F.col("doc").alias("group"), "classification", "year", F.col("content").alias("text"))


def literal_between(text: Column, start: str, end: str) -> Column:
    """What stands between two literals, over line ends."""
    import re

    return F.regexp_extract(text, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Error records of JSON lines; what can't be parsed gives nulls."""
    return lines.select(F.from_json(column, LOG_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.message", "r.source", "r.lineno", "r.stack")


ORDERED_INCIDENTS = T.StructType([*INCIDENT_SCHEMA.fields, T.StructField("ord", T.LongType())])


def seed_incidents(spark: SparkSession) -> DataFrame:
    """The incidents that are always in the registry, as ``read_incidents`` gives them."""
    return spark.createDataFrame([(*row, k) for k, row in enumerate(SEED_INCIDENTS)], ORDERED_INCIDENTS)


def generate_incidents(spark: SparkSession, rows: int = 95, seed: int = 42, numbers: DataFrame | None = None) -> DataFrame:
    """Synthetic incidents as ``read_incidents`` gives them, the same for the same seed.

    There is one for each of 1 to ``rows``, or for each ``n`` of ``numbers``.
    What is drawn follows from the digest of seed, draw and number.
    """

    def pick(salt: int, values: tuple) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("n").cast("string")).cast("binary"))
        drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return F.element_at(F.array(*[F.lit(v) for v in values]), (drawn % len(values) + 1).cast("int"))

    base = spark.range(1, rows + 1).select(F.col("id").alias("n")) if numbers is None else numbers.select(F.col("n").cast("long").alias("n"))
    drawn = base.select("n", pick(1, tuple(k for k, _, _ in ATTACKS)).alias("type"), F.concat_ws(" ", pick(2, INSTITUTIONS), pick(3, CITIES)).alias("place"), pick(4, YEARS).alias("year"))
    kind = F.col("type")
    of_kind = lambda k: F.element_at(F.create_map(*[F.lit(x) for a in ATTACKS for x in (a[0], a[k])]), kind)
    # What a kind of attack is qualified as, strikes at and leads to.
    qualified = F.when(kind == "ransomware", "Tindak Pidana Ekstorsi & Illegal Access (Pasal 27 ayat 4 & Pasal 30 UU ITE)").when(kind == "data_breach", "Pelanggaran UU Pelindungan Data Pribadi (Kegagalan Pseudo-Anonimisasi)").when(kind.isin("ai_misuse", "ai_fraud"), "Tindak Pidana Penipuan Siber Identitas Sintetis (Social Engineering)").otherwise("Perbuatan Melawan Hukum Siber")
    struck = F.when(kind == "data_breach", "Data Demografi dan Rekam Medis/Administratif Warga").when(kind.isin("ai_misuse", "ai_fraud"), "Kehormatan Pejabat & Harta Benda Korban Finansial").otherwise("Ketersediaan Sistem & Keamanan Data Spesifik")
    effect = F.when(kind.isin("ai_misuse", "ai_fraud"), "Kerugian finansial perdata warga yang tertipu oleh algoritma deepfake.").otherwise("Kerugian akses layanan publik dan hilangnya kredibilitas PSE.")
    facts = F.struct(
        F.lit("Sindikat kejahatan siber tak berpola (Anonymous/Scammers).").alias("subjek_pelaku"),
        F.concat(F.lit("Masyarakat pengguna layanan dan pejabat "), "place", F.lit(".")).alias("subjek_korban"),
        F.concat("place", F.lit(" selaku Penyelenggara Sistem Elektronik / Lembaga Pemerintah.")).alias("subjek_pse"),
        struck.alias("objek_hukum"),
        effect.alias("akibat_hukum"),
        F.lit("Ketidakpatuhan pembaruan (patching) sistem keamanan SPBE daerah berujung pada invasi peretas.").alias("nexus_kausalitas"),
    )
    return drawn.select(F.concat(F.lit("incident-auto-"), F.col("n").cast("string")).alias("id"), F.concat(of_kind(2), F.lit(" milik instansi "), "place", F.lit(".")).alias("peristiwa_hukum_kronologi"), qualified.alias("kualifikasi_peristiwa"), facts.alias("pemetaan_fakta_hukum"), of_kind(1).alias("severity"), F.col("year").cast("int").alias("year"), "type", F.col("n").alias("ord"))


def registry_incidents(spark: SparkSession, rows: int = 95, seed: int = 42) -> DataFrame:
    """The fixed incidents, then the generated ones."""
    first = seed_incidents(spark)
    return first.unionByName(generate_incidents(spark, rows, seed).withColumn("ord", F.col("ord") + len(SEED_INCIDENTS) - 1))
