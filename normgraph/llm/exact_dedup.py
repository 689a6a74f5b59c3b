"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind Spark's
``approx_top_k`` functions) names the digests that may be frequent.  One exact
count keeps the true winners, which are broadcast: their rows are decided
map-side and never shuffled.  Every remaining digest holds at most
``rows / capacity`` rows and takes an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.llm.common import materialize, text_or_empty

#: Counters of the summary: a digest with more than 1 / CAPACITY of the rows is
#: always among them, and no more than this many winners are ever broadcast.
CAPACITY = 1024
#: Groups of partitions whose summaries are merged before the last merge.
FAN_IN = 64


def frequent_digests(digests: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """At most ``capacity`` values of ``column``, all frequent ones among them.

    Summaries are built per task, merged in ``FAN_IN`` groups and then once
    more, so the last task reads ``FAN_IN`` small sketches at any input size.
    """
    tracked = 4 * capacity
    part = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("_part")).agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("_s"))
    # grouped by one key, so that tasks without rows send no empty sketch
    whole = part.groupBy(F.pmod("_part", F.lit(1)).alias("_all")).agg(F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {capacity})")).alias("_e")).select(F.col("_e.item").alias(column))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has
    become one space; a null text counts as empty.  keep_id is the smallest
    non-null id of the group (null if it has none), group_size its rows.
    Repeated rows each count, and every row that carries keep_id has kept =
    true; so has a group of null ids only.  Extra columns are ignored, an empty
    table gives an empty result.
    """
    digests = materialize(docs.select(F.col(id_col).alias("_id"), F.sha2(F.regexp_replace(text_or_empty(text_col), "[\\x20\\x09-\\x0D]+", " "), 256).alias("_d")), "digests")
    facts = (F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_keep"))
    total = digests.count()
    winners = materialize(digests.join(F.broadcast(frequent_digests(digests, "_d", capacity)), "_d", "left_semi").groupBy("_d").agg(*facts).where((F.col("_n") > 1) & (F.col("_n") * capacity > total)), "winners")
    hot = digests.join(F.broadcast(winners), "_d", "inner")
    rest = digests.join(F.broadcast(winners.select("_d")), "_d", "left_anti")
    groups = rest.groupBy("_d").agg(*facts)
    cold = rest.join(groups, "_d", "inner")
    both = hot.select("_id", "_d", "_n", "_keep").unionByName(cold.select("_id", "_d", "_n", "_keep"))
    return both.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_d").alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
