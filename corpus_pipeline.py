"""The corpus pipeline: toxicity, line dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``documents`` (doc_id, text, lang, source, n_chars) and no
others that ``docs`` may have.  Every stage's result is written to the shared
folder and read again as the next one's input.  In every stage nulls may stand
in any column, rows may repeat, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm import line_dedup, minhash, packing, secret_scan, toxicity
from normgraph.llm.common import BROADCAST_ROWS, materialize, new_path, release, scope, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date with the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go.

    The model is fitted on the labelled rows of ``docs``; where there are none
    of both kinds, all documents stay.  A null or empty text is clean; repeated
    rows share their fate.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs.select(*COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the one of the largest id; every document stays.

    A null text becomes an empty one.  Repeated rows count one by one, and all
    rows of the largest id keep the line; a null id is below every other.
    """
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of near-duplicates (five-word shingles, 0.8).

    Texts without words are in no group and stay.  Rows of one id count as one
    document: all of them stay or, those of one text together, go.  A row without
    an id goes if its group has a row with one; rows without ids can't be told
    apart, so a group of such rows only stays.
    """
    found = materialize(minhash.near_duplicates(docs), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark")).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mark = F.xxhash64(text_or_empty("text"))
    rows = docs.select(*COLUMNS)
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; every document stays, a null text as it is."""
    return _documents(secret_scan.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it.

    A null or empty text is one piece of the end token; repeated rows and rows
    without an id are packed row by row; ties in length go by id.
    """
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage applies a fitted model; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes when it has ended, a stage's rows when the next one has them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with scope(spark) as here:
        for name, stage in STAGES[:-1]:
            path = new_path(spark, f"stage-{name}")
            with scope(spark, keep=False):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                release(spark, keep=set(here.paths) - {before})
            before = path
        return STAGES[-1][1](spark, docs, sf_dir)
