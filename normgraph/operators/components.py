"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.storage import materialize, settled

#: Links that a task joins at once.
PART = 1 << 20


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is joined with) of the nodes of these links but the smallest ones."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while len(a):
        x, y = label[a], label[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, upper := label[label]):
            label = upper
    hangs = label < np.arange(len(names))
    return names[hangs], names[label[hangs]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link a node at most that join what a task's links do."""
    stars, kept, rows = (np.empty(0, np.int64),) * 2, [], 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        return _joined(*(np.concatenate(x) for x in zip(stars, *kept)))

    for batch in batches:
        kept.append(tuple(c.to_numpy() for c in batch.columns))
        rows += batch.num_rows
        if rows >= PART:
            stars, kept, rows = taken(), [], 0
    stars = taken()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars], names=["u", "v"])


def forest(links: DataFrame) -> DataFrame:
    """(u, v) of links that join what those of ``links`` (u, v), between long numbers, do: of each task one a node at most."""
    return links.mapInArrow(_forest, "u long, v long")


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, low): the smallest of each node and its neighbours, as a written table.

    The group sums are partial before they are shuffled; written out, both
    sides of the join that follows are plain exchanges, which the optimizer may
    split where a node has very many neighbours.
    """
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "star-low")


def _are_stars(stars: DataFrame) -> bool:
    """Whether every node hangs on one node, which itself hangs on none.

    A sum over nodes, partial before its exchange: far less than the round
    that would only show that nothing changes any more.
    """
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))
    nodes = stars.select(F.inline(ends)).groupBy("node").agg(F.sum("hangs").alias("up"), F.min("hangs").alias("least"))
    return nodes.where("up > 1 OR (up = 1 AND least = 0)").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, left: str, right: str, many: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest node it sees; the depth shrinks geometrically, and rounds end as
    soon as all that is left are stars.  Links and components stay distributed;
    only one count a round reaches the driver.  Rows with a null end and loops
    are ignored.  Of very many links between far fewer nodes, which are long
    numbers, each task's become one a node at most before they are dealt.
    """
    return settled(edges.sparkSession, "components", lambda: _components(edges, left, right, many))


def _components(edges: DataFrame, left: str, right: str, many: bool) -> DataFrame:
    links = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v")
    if many:
        links = forest(links)
    stars = materialize(links.distinct(), "stars")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large = materialize(large, "stars-large")
        low = _lowest(large)
        hung = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = materialize(hung.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), "stars")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
