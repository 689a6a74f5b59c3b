"""Incremental intake of client error records and incidents with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normgraph.sources import LOG_SCHEMA
from normgraph.sources.sinks import log_lines


def error_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(message, source, lineno, stack) of JSON lines that arrive in a folder."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.from_json("value", LOG_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.message", "r.source", "r.lineno", "r.stack")


def write_error_log(records: DataFrame, path: str, checkpoint: str, stamp: str) -> StreamingQuery:
    """Append formatted records to a log folder, each exactly once per checkpoint; stops when the input is used up."""
    lines = log_lines(records, stamp).withColumnRenamed("line", "value")
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
