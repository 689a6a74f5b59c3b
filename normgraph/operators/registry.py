"""Incident search, sector coverage and compliance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions.prompts import ARGUMENT_PROMPT, COMPLIANCE_PROMPT, KIND_NAMES, NO_DESCRIPTION, NO_REGULATIONS, SECTOR_NAMES
from normgraph.functions.tables import COMPLIANCE

# Sectors with their coverage scores (constants, not derived from
# the statuses) and how many provisions are covered, partial and missing.
SECTORS = [
    ("fintech", "Keuangan & Fintech AI", 38, 1, 2, 3),
    ("facial", "Facial Recognition & Biometrik", 22, 0, 2, 3),
    ("ecommerce", "E-Commerce & Perdagangan Digital", 29, 1, 2, 3),
    ("content", "AI-Generated Content & Media", 35, 0, 3, 3),
    ("judicial", "AI di Peradilan & Hukum", 18, 1, 1, 3),
]
OTHER = "other"
# Curated links between provisions of one theme.
THEMATIC = [
    ("EU_AI_Act_2024_Article_13", "OECD_AI_Principles_2024_Section_1", "Transparansi & Eksplainabilitas"),
    ("EU_AI_Act_2024_Article_13", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_5", "Transparansi & Eksplainabilitas"),
    ("EU_AI_Act_2024_Article_9", "OECD_AI_Principles_2024_Section_2", "Manajemen Risiko"),
    ("EU_AI_Act_2024_Article_9", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_9", "Manajemen Risiko"),
    ("EU_AI_Act_2024_Article_6", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_6", "Manajemen Risiko"),
    ("EU_AI_Act_2024_Article_14", "OECD_AI_Principles_2024_Article_5", "Pengawasan Manusia"),
    ("EU_AI_Act_2024_Article_14", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_10", "Pengawasan Manusia"),
    ("EU_AI_Act_2024_Article_10", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_11", "Tata Kelola Data"),
    ("EU_AI_Act_2024_Article_16", "OECD_AI_Principles_2024_Section_2", "Akuntabilitas"),
    ("EU_AI_Act_2024_Article_16", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_8", "Akuntabilitas"),
    ("EU_AI_Act_2024_Article_5", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_5", "Larangan Penggunaan AI Berbahaya"),
    ("EU_AI_Act_2024_Article_26", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_7", "Kewajiban Penyedia AI"),
    ("EU_AI_Act_2024_Article_39", "Council_of_Europe_Framework_Convention_on_AI_CETS225_Article_25", "Conformity & Sertifikasi"),
    ("EU_AI_Act_2024_Article_54", "OECD_AI_Principles_2024_Section_1", "Regulatory Sandbox"),
]


def search(incidents: DataFrame, query: str, fields: tuple[str, ...], kind: str = "all", type_col: str = "type") -> DataFrame:
    """Incidents of a type (``all``: any) with ``query`` in one of ``fields``, whatever the case; an empty query fits all."""
    q = query.lower()
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(q))
    return incidents.where(hit & (F.lit(True) if kind == "all" else F.col(type_col) == kind))


def sectors(spark: SparkSession) -> DataFrame:
    """(sector, title, score, covered, partial, gap, band)."""
    from normgraph.functions.bands import sector_band

    rows = spark.createDataFrame(SECTORS, "sector string, title string, score int, covered int, partial int, gap int")
    return rows.withColumn("band", sector_band(F.col("score")))


def status_counts(rows: DataFrame, by: str, status: str = "status", values: tuple[str, ...] = ("covered", "partial", "gap")) -> DataFrame:
    return rows.groupBy(by).agg(*[F.sum((F.col(status) == v).cast("long")).alias(f"n_{v}") for v in values])


def compliance_rules(spark: SparkSession) -> DataFrame:
    """(sector, status, title, desc, recom, ord)."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(COMPLIANCE)], "sector string, status string, title string, desc string, recom string, ord long")


def navigate(requests: DataFrame, rules: DataFrame, sector: str = "sector") -> DataFrame:
    """Rules of each request's sector; an unknown or null one gets those of ``other``."""
    known = rules.select("sector").distinct().withColumnRenamed("sector", "_known")
    asked = requests.join(known, F.col(sector) == F.col("_known"), "left").withColumn("_use", F.coalesce("_known", F.lit(OTHER))).drop("_known")
    named = rules.withColumnsRenamed({"sector": "_use", "ord": "rule_ord"})
    return asked.join(named, "_use").drop("_use")


def thematic_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(THEMATIC)], "src string, dst string, type string, ord long")


def rule_lines(rules: DataFrame, by: str = "sector") -> DataFrame:
    """(by, lines): a key's rules, one to a line, as prompts list them."""
    line = F.concat(F.lit("- ["), F.upper("status"), F.lit("] "), "title", F.lit(": "), "desc")
    listed = rules.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return listed.select(by, F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("lines"))


def prompt(template: str, fields: dict[str, Column]) -> Column:
    """A prompt text with ``{name}`` replaced by columns; no model is called here."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def _named(value: Column, names: dict[str, str]) -> Column:
    """The name of a key, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value], value)


def compliance_prompts(requests: DataFrame, rules: DataFrame, sector: str = "sector", kind: str = "kind", description: str = "description") -> DataFrame:
    """``requests`` with ``prompt``, which lists the rules of their sector (those of ``other`` where it is unknown or null).

    Unknown kinds and sectors stand as they are; a null or empty description has
    a text of its own.  Rules are few, so they are broadcast.
    """
    lines = rule_lines(rules.withColumnRenamed("sector", "_use"), "_use").withColumnRenamed("lines", "_lines")
    known = F.broadcast(rules.select(F.col("sector").alias("_known")).distinct())
    asked = requests.join(known, F.col(sector) == F.col("_known"), "left").withColumn("_use", F.coalesce("_known", F.lit(OTHER)))
    filled = asked.join(F.broadcast(lines), "_use")
    told = F.when(F.coalesce(F.col(description), F.lit("")) == "", F.lit(NO_DESCRIPTION)).otherwise(F.col(description))
    text = prompt(COMPLIANCE_PROMPT, {"sector": _named(F.col(sector), SECTOR_NAMES), "kind": _named(F.col(kind), KIND_NAMES), "rules": F.col("_lines"), "description": told})
    return filled.withColumn("prompt", text).drop("_known", "_use", "_lines")


def argument_prompts(incidents: DataFrame) -> DataFrame:
    """(id, prompt) of (id, text, n_warrants, context) rows: an incident's facts beside the regulations that were found for it."""
    found = F.when(F.coalesce("context", F.lit("")) == "", F.lit(NO_REGULATIONS)).otherwise(F.col("context"))
    return incidents.select("id", prompt(ARGUMENT_PROMPT, {"count": F.col("n_warrants"), "incident": F.col("text"), "regulations": found}).alias("prompt"))
