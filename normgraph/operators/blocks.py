"""Biconnected blocks of a graph, by joins, and how many nodes hang on each of their nodes.

All trees are grown breadth first at once, so an edge outside of them never
leads from a node to an ancestor of it.  Tree edges (each named by its lower
node) belong to one block when an edge outside of the trees joins their lower
nodes, or when such an edge leaves both the lower and the upper one's subtree;
places in preorder tell which subtree a node is in.  Tables stay distributed;
rounds grow with the depth of the trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.operators.components import connected_components
from normgraph.operators.ranking import running_sums
from normgraph.storage import materialize


@dataclass(frozen=True)
class Blocks:
    """``members(block, node, weight, starts, total, total_starts)`` and ``pairs(block, u, v)``.

    weight counts the nodes that reach the block through this one, itself
    included, and starts those of them that are starts; the totals are those of
    the component.  A node is in several blocks if it is where they meet, a pair
    (in both directions) in one.  A block's name is the smallest of its nodes
    but its top.
    """

    members: DataFrame
    pairs: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _grown(pairs: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Levels (node, parent, depth) of trees from all roots; a node hangs on its smallest neighbour of the level above."""
    levels = [materialize(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")), "tree")]
    while True:
        seen = _union(levels).select(F.col("node").alias("v"))
        step = levels[-1].join(pairs, F.col("node") == F.col("u")).select("u", "v").join(seen, "v", "left_anti")
        level = materialize(step.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")).withColumn("depth", F.lit(len(levels))), "tree")
        if level.isEmpty():
            return levels
        levels.append(level)


def _gathered(levels: list[DataFrame], sums: dict[str, str]) -> list[DataFrame]:
    """Levels with each column added up (or its min or max taken) over the node's whole subtree, from the lowest level up."""
    pick = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}
    done, below = [], None
    for level in reversed(levels):
        if below is not None:
            level = level.join(below, F.col("node") == F.col("_up"), "left").select(*[pick[sums[c]](F.col(c), F.col("_" + c)).alias(c) if c in sums else F.col(c) for c in level.columns])
        level = materialize(level, "subtrees")
        below = level.groupBy(F.col("parent").alias("_up")).agg(*[getattr(F, how)(c).alias("_" + c) for c, how in sums.items()])
        done.insert(0, level)
    return done


def _numbered(levels: list[DataFrame]) -> DataFrame:
    """(node, parent, depth, size, starts, pre): a subtree's nodes have the ``size`` places from its root's ``pre`` on."""
    named = _union(levels)
    # a child's place follows its elder siblings' subtrees, however many children a node has
    placed = materialize(running_sums(named.where("depth > 0"), "parent", ("node",), F.col("size"), "upto").select("node", "parent", "depth", "size", "starts", (F.col("upto") - F.col("size") + 1).alias("after")), "siblings")
    above = materialize(levels[0].withColumn("pre", F.lit(0).cast("long")), "preorder")
    out = [above]
    for depth in range(1, len(levels)):
        up = above.select(F.col("node").alias("parent"), F.col("pre").alias("_pre"))
        above = materialize(placed.where(F.col("depth") == depth).join(up, "parent").select("node", "parent", "depth", "size", "starts", (F.col("_pre") + F.col("after")).alias("pre")), "preorder")
        out.append(above)
    return _union(out)


def blocks(pairs: DataFrame, starts: DataFrame) -> Blocks:
    """The blocks of the graph of adjacent ``pairs`` (u, v), both directions and u <> v; parallel pairs all stay.

    ``starts`` has the nodes (node) to count apart, each once.  Nodes without a
    pair are in no block; a bridge is a block of two.
    """
    simple = materialize(pairs.distinct(), "simple-pairs")
    parts = connected_components(simple, "u", "v")
    levels = _grown(simple, parts.where("node = component").select("node"))
    chosen = starts.select("node", F.lit(1).cast("long").alias("starts"))
    marked = [x.join(chosen, "node", "left").select("node", "parent", "depth", F.lit(1).cast("long").alias("size"), F.coalesce("starts", F.lit(0).cast("long")).alias("starts")) for x in levels]
    tree = materialize(_numbered(_gathered(marked, {"size": "sum", "starts": "sum"})), "numbered")

    end = tree.select("node", "parent", "depth", "pre")
    a, b = (end.withColumnsRenamed({"node": x, "parent": f"up_{x}", "depth": f"depth_{x}", "pre": f"pre_{x}"}) for x in ("u", "v"))
    ends = materialize(simple.join(a, "u").join(b, "v"), "pair-ends")
    others = ends.where("NOT (up_u <=> v) AND NOT (up_v <=> u)")
    reach = others.groupBy(F.col("u").alias("node")).agg(F.min("pre_v").alias("_low"), F.max("pre_v").alias("_high"))
    reaching = materialize(tree.join(reach, "node", "left").select("node", "parent", "depth", F.least("pre", "_low").alias("low"), F.greatest("pre", "_high").alias("high")), "reach")
    reached = _union(_gathered([reaching.where(F.col("depth") == k) for k in range(len(levels))], {"low": "min", "high": "max"}))
    upper = tree.where("depth > 0").select(F.col("node").alias("parent"), "pre", "size")
    leaving = reached.join(upper, "parent").where("low < pre OR high >= pre + size").select(F.col("node").alias("u"), F.col("parent").alias("v"))
    links = materialize(others.where("u < v").select("u", "v").unionByName(leaving), "block-links")

    named = connected_components(links, "u", "v")
    lower = materialize(tree.where("depth > 0").join(named, "node", "left").select("node", "parent", "depth", "size", "starts", F.coalesce("component", "node").alias("block")), "block-nodes")
    tops = lower.groupBy("block").agg(F.min(F.struct("depth", "parent")).alias("x")).select("block", F.col("x.parent").alias("top"))
    below = materialize(lower.join(tops, "block").where("parent = top").groupBy("block", "top").agg(F.sum("size").alias("below"), F.sum("starts").alias("below_starts")), "below")
    hanging = below.groupBy(F.col("top").alias("node")).agg(F.sum("below").alias("weight"), F.sum("below_starts").alias("starts"))
    own = lower.select("block", "node").join(hanging, "node", "left").join(chosen.withColumnRenamed("starts", "own"), "node", "left")
    zero = F.lit(0).cast("long")
    own = own.select("block", "node", (F.coalesce("weight", zero) + 1).alias("weight"), (F.coalesce("starts", zero) + F.coalesce("own", zero)).alias("starts"))
    totals = tree.where("depth = 0").select(F.col("node").alias("component"), F.col("size").alias("total"), F.col("starts").alias("total_starts"))
    whole = parts.join(totals, "component").select("node", "total", "total_starts")
    lows = own.join(whole, "node").select("block", "node", "weight", "starts", "total", "total_starts")
    highs = below.withColumnRenamed("top", "node").join(whole, "node").select("block", "node", (F.col("total") - F.col("below")).alias("weight"), (F.col("total_starts") - F.col("below_starts")).alias("starts"), "total", "total_starts")

    # the lower end of a pair names its block: of a tree edge, that is the edge's own; ends of any other are in one block
    deep, flat = (lower.select(F.col("node").alias(x), F.col("block").alias(f"block_{x}"), F.col("depth").alias(f"at_{x}")) for x in ("u", "v"))
    at = pairs.join(deep, "u", "left").join(flat, "v", "left").select(F.when(F.coalesce("at_u", F.lit(0)) >= F.coalesce("at_v", F.lit(0)), F.col("block_u")).otherwise(F.col("block_v")).alias("block"), "u", "v")
    return Blocks(materialize(lows.unionByName(highs), "members"), materialize(at, "block-pairs"))
