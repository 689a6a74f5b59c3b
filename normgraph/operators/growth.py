"""A similarity graph that is kept up as its corpus grows.

Each batch of rows is dealt to blocks once; the blocks are kept in a ledger.  A
new batch meets itself and the blocks that are there, skipping cells as any
similarity join does, and old rows never meet each other again.  All batches have
the first one's pivots, so that their blocks can be told apart.  Components are
merged: each task's links become one a node at most, and only what they join of
old labels and new nodes goes through a components job.

A version is a small file that names its parts; it is written last and put in
place by one rename, so that a batch that fails leaves the former version whole.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators.components import connected_components, forest
from normgraph.operators.similarity import Dealt, Rings, block_rows, cell_counts, dealt, dealt_pairs, kind_of
from normgraph.storage import materialize, scope

EDGES, LABELS = "src long, dst long, score double", "node long, component long"
ROWS = "ord long, `group` string, vector array<{}>, block int"


class GrowingGraph:
    """The graph of all pairs with a cosine of at least ``threshold``, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, cross_group: bool = True, block: int | None = None):
        self.spark, self.path, self.threshold, self.cross_group, self.block = spark, path.rstrip("/"), threshold, cross_group, block
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._at(f"{self.path}/versions"))

    # --- versions

    def version(self) -> int:
        """How many batches there are."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._at(f"{self.path}/versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _parts(self) -> list[dict]:
        now = self.version()
        if not now:
            return []
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{now}").first()[0])

    def _publish(self, parts: list[dict]) -> None:
        staged = self._at(f"{self.path}/staged-{uuid.uuid4().hex}")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self._files.rename(staged, self._at(f"{self.path}/versions/{len(parts)}")):
            raise RuntimeError(f"version {len(parts)} of {self.path} is there already")

    # --- tables

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, part: dict, kind: str) -> DataFrame:
        """One batch's rows, its vectors as ``kind``; they are kept as single numbers where they came so."""
        rows = self._read(ROWS.format(part.get("kind", "double")), [part["rows"]])
        return rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))

    def _side(self, part: dict, kind: str) -> Dealt:
        """One batch's rows and blocks; a ledger has as many rows as there are blocks and pivots."""
        pivots, rings = (self.spark.read.parquet(f"{part['blocks']}/{x}").orderBy("k").collect() for x in ("pivots", "rings"))
        low, high = (np.array([r[c] for r in rings], float).reshape(len(rings), len(pivots)) for c in ("low", "high"))
        return Dealt(self._rows(part, kind), Rings(np.array([r.pivot for r in pivots], float).reshape(len(pivots), -1) if pivots else np.empty((0, 0)), low, high))

    def rows(self) -> DataFrame:
        """(ord, group, vector) of all rows that take part."""
        found = self._read(ROWS.format("double"), [])
        for kind in ("float", "double"):
            if paths := [p["rows"] for p in self._parts() if p.get("kind", "double") == kind]:
                found = found.unionByName(self._read(ROWS.format(kind), paths).withColumn("vector", F.col("vector").cast("array<double>")))
        return found.drop("block")

    def edges(self) -> DataFrame:
        """(src, dst, score), src < dst: what a join of all rows gives."""
        return self._read(EDGES, [p["edges"] for p in self._parts()])

    def components(self) -> DataFrame:
        """(node, component) of every node that has an edge; component is its smallest node."""
        parts = self._parts()
        return self._read(LABELS, [parts[-1]["labels"]] if parts else [])

    # --- growth

    def add(self, rows: DataFrame) -> tuple[int, int]:
        """Take in a batch of (ord, group, vector); gives (cells met, cells skipped) of its joins.

        Rows of an ord that is there already are left out, and of several rows of
        one ord the batch keeps one.  Nulls are as ``similar_pairs`` says.
        """
        parts = self._parts()
        name = f"{self.path}/batch-{len(parts)}-{uuid.uuid4().hex}"
        part = {k: f"{name}/{k}" for k in ("rows", "blocks", "edges", "labels")}
        with scope(self.spark, keep=False):
            part["kind"] = kind_of(rows)
            kind = "float" if all(p.get("kind", "double") == "float" for p in [*parts, part]) else "double"
            there = self.rows()
            fresh = rows.select("ord", "group", F.col("vector").cast(f"array<{part['kind']}>").alias("vector")).dropDuplicates(["ord"]).join(there.select("ord"), "ord", "left_anti")
            fresh = materialize(fresh, "fresh")
            block = self.block or block_rows(fresh, there.count() + fresh.count())
            old = None
            for earlier in (self._side(p, kind) for p in parts):
                if len(earlier.rings.low):  # a batch without rows has no blocks
                    old = earlier if old is None else old.with_blocks_of(earlier)
            side = dealt(fresh, block, old.rings.pivots if old is not None else None)
            side.rows.write.parquet(part["rows"])
            pivots = [(k, p.tolist()) for k, p in enumerate(side.rings.pivots)]
            self.spark.createDataFrame(pivots, "k int, pivot array<double>").coalesce(1).write.parquet(f"{part['blocks']}/pivots")
            rings = [(k, low.tolist(), high.tolist()) for k, (low, high) in enumerate(zip(side.rings.low, side.rings.high))]
            self.spark.createDataFrame(rings, "k int, low array<double>, high array<double>").coalesce(1).write.parquet(f"{part['blocks']}/rings")
            side = Dealt(self._rows(part, kind), side.rings)
            found = dealt_pairs(side, None, self.threshold, self.cross_group)
            met, skipped = cell_counts(side, None, self.threshold)
            if old is not None:
                found = found.unionByName(dealt_pairs(old, side, self.threshold, self.cross_group))
                more = cell_counts(old, side, self.threshold)
                met, skipped = met + more[0], skipped + more[1]
            found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score").write.parquet(part["edges"], compression="zstd")
            self._merged(self._read(EDGES, [part["edges"]])).write.parquet(part["labels"])
        self._publish([*parts, part])
        return met, skipped

    def _merged(self, links: DataFrame) -> DataFrame:
        """Labels after ``links``: old labels that they connect become one, the smallest."""
        old = self.components()
        # what is dealt from here on grows with nodes and tasks, not with links
        named = materialize(forest(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))).toDF("src", "dst"), "forest")
        for end in ("src", "dst"):
            label = old.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
            named = named.join(label, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
        ends = named.select("src_label", "dst_label")
        joined = connected_components(ends, "src_label", "dst_label").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        new = named.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_label").alias("component")), F.struct(F.col("dst").alias("node"), F.col("dst_label").alias("component")))).alias("x")).select("x.*").distinct()
        every = old.unionByName(new.join(old.select("node"), "node", "left_anti"))
        return every.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
