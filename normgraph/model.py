"""The graph that every operator works on: two tables and their schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("year", T.IntegerType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("ord", T.LongType()),
])

#: Classification of incident nodes.
INCIDENT = "Insiden Kasus"

#: Rows of a table of nodes that is broadcast to the edges; larger ones are dealt with them.
FEW = 1_000_000


def few(nodes: DataFrame) -> DataFrame:
    """``nodes`` to be broadcast if there are few: edges then stay where they are."""
    return F.broadcast(nodes) if nodes.limit(FEW + 1).count() <= FEW else nodes


@dataclass(frozen=True)
class Graph:
    """``nodes(id, ord, label, group, classification, year)`` and ``edges(src, dst, type, weight, ord)``.

    ord is the place of a row in its source: every tie is broken by it.  Edges
    may also bring their ends' node ords as a (of src) and b (of dst); both ends
    are nodes then, and operators that can do without the ids take the numbers.
    """

    nodes: DataFrame
    edges: DataFrame

    def simple(self) -> Graph:
        """Undirected, without parallel edges: the earlier node comes first, the first edge's type and the last edge's weight stay."""
        place = self.nodes.select("id", F.col("ord").alias("_o"))
        e = self.edges.join(place.withColumnsRenamed({"id": "src", "_o": "_s"}), "src").join(place.withColumnsRenamed({"id": "dst", "_o": "_d"}), "dst")
        swap = F.col("_s") > F.col("_d")
        e = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type", "weight", "ord")
        merged = e.groupBy("src", "dst").agg(F.min_by("type", "ord").alias("type"), F.max_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))
        return Graph(self.nodes, merged)

    def numbered(self) -> DataFrame:
        """(a, b, ord) of the edges between nodes, by their ends' ords."""
        if {"a", "b"} <= set(self.edges.columns):
            return self.edges.select("a", "b", "ord")
        place = few(self.nodes.select("id", F.col("ord").alias("_o")))
        return self.edges.join(place.withColumnsRenamed({"id": "src", "_o": "a"}), "src").join(place.withColumnsRenamed({"id": "dst", "_o": "b"}), "dst").select("a", "b", "ord")

    def endpoints(self) -> DataFrame:
        """(id, other, type, weight, ord): every edge seen from both of its ends."""
        e = self.edges
        back = e.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", "weight", "ord")
        return e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", "weight", "ord").unionByName(back)
