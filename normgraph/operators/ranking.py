"""Deterministic ranks: descending score, ties in source order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normgraph.storage import materialize


def top(df: DataFrame, by: Column, k: int, tie: str = "ord") -> DataFrame:
    """The ``k`` best rows with their 1-based ``rank``; only they are sorted together."""
    best = df.withColumn("_by", by).orderBy(F.col("_by").desc(), F.col(tie).asc()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_by").desc(), F.col(tie).asc())).cast("long")).drop("_by")


def global_rank(df: DataFrame, by: Column, name: str = "rank", tie: str = "ord") -> DataFrame:
    """Every row with its 1-based rank, without gathering all rows in one task.

    Rows are dealt by ranges of the sort key, sorted and numbered within their
    range as they are written (``monotonically_increasing_id`` is the range and,
    in its lower 33 bits, the place in it); the ranges' row counts, one number
    each, give the offsets.  So there is one exchange.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("_by").desc(), F.col(tie).asc())
    dealt = df.withColumn("_by", by).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).drop("_by")
    dealt = materialize(dealt, "ranges").withColumn("_range", F.shiftright("_place", 33))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row for each range
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base") + 1).cast("long")).drop("_place", "_range", "_base")


def running_sums(df: DataFrame, key: str, order: tuple[str, ...], value: Column, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` over a key's rows up to each one, however many rows a key has.

    Rows are dealt by ranges of key and order, so that a key of very many rows
    lies in several ranges; sums are made within key and range, and what a key
    has in the ranges before is added.  Only keys that go on from one range into
    the next have such rows, one at most for each range, so they are broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = (key, *order)
    dealt = df.withColumn("_value", value).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    dealt = materialize(dealt, "segments").withColumn("_range", F.shiftright("_place", 33))
    inside = Window.partitionBy("_range", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("_range", key).agg(F.sum("_value").alias("_sum"))
    several = ends.groupBy(key).agg(F.count(F.lit(1)).alias("_ranges")).where("_ranges > 1").select(F.col(key).alias("_key"))
    spread = ends.join(several, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.select(F.col("_range").alias("_r"), F.col(key).alias("_key"), F.sum("_sum").over(before).alias("_base"))
    summed = dealt.withColumn(name, F.sum("_value").over(inside)).join(F.broadcast(bases), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return summed.withColumn(name, F.col(name) + F.coalesce("_base", F.lit(0))).drop("_value", "_place", "_range", "_r", "_key", "_base")


def value_at(df: DataFrame, by: str, share: float, tie: str = "ord") -> DataFrame:
    """One row (value): ``by`` at 0-based place floor(share * rows) of the descending order, 0 without such a row."""
    ranks = global_rank(df.select(by, tie), F.col(by), "_rank", tie)
    place = df.agg(F.floor(F.count(F.lit(1)) * share).alias("_place"))
    hit = ranks.join(F.broadcast(place), F.col("_rank") - 1 == F.col("_place"))
    return hit.agg(F.coalesce(F.max(by), F.lit(0.0)).alias("value"))


def newest_first(df: DataFrame, year: str = "year", default: int = 2024, tie: str = "ord") -> DataFrame:
    """Every row with its 1-based rank by year, newest first; a missing year counts as ``default``, ties stay in source order."""
    return global_rank(df, F.coalesce(F.col(year), F.lit(default)), "rank", tie)


def head(df: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """The first ``k`` rows in source order and, if more, a last one with ``more`` = how many."""
    first = df.orderBy(order).limit(k).withColumn("more", F.lit(None).cast("long"))
    rest = df.agg((F.count(F.lit(1)) - k).alias("more")).where(F.col("more") > 0)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return first.unionByName(rest.select(*nulls, "more"))
