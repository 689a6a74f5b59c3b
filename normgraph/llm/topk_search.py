"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout: a chunk is one array per dimension.  A tile
of queries adds up scores dimension block by dimension block; after each block
a pair's score so far plus the product of what is left of both vectors' norms
(Cauchy-Schwarz) bounds its final score, and pairs that cannot reach their
query's k-th best so far are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map, materialize

#: Queries in a query block (one shuffled group), in a tile, candidates in a chunk.
QUERY_BLOCK, TILE, CHUNK = 4096, 128, 4096
#: Candidates that meet a query block in one task.
CANDIDATE_BLOCK = 131_072
#: Dimensions added up between two looks at the bounds.
DIM_BLOCK = 16
#: Share of a tile's pairs below which survivors are compacted to a pair list.
SPARSE = 0.05
SLACK = 1 + 1e-9
#: Sums below this bound are exact as doubles, below that one as longs; wider ones are added up as Python's integers.
DOUBLE, LONG = 2.0**52, 2.0**62


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors without nulls and non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, floor).alias("v"))


def tails_of(columns: np.ndarray) -> np.ndarray:
    """Norms of what is left from each dimension on; vectors are columns."""
    x = columns.astype(np.float64)
    return np.sqrt(np.cumsum((x * x)[::-1], axis=0)[::-1])


class Tile:
    """Queries with their k best so far, in descending score, then ascending id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.tails = tails_of(q.T).T
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def scan(self, ids: np.ndarray, columns: np.ndarray, tails: np.ndarray) -> None:
        """Meet one chunk: ``columns`` is dimensions x candidates, ``tails`` the norms of what is left."""
        dims, n = columns.shape
        q = self.q
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(columns).max(initial=0)) * dims
        if largest < DOUBLE:
            q, columns = q.astype(np.float64), columns.astype(np.float64)  # exact, and faster than integers
        elif largest >= LONG:
            q, columns = q.astype(object), columns.astype(object)
        # the slack covers the rounding of the square roots, the margin that of scores beyond DOUBLE
        margin = 1.0 + largest * 1e-12
        score = np.zeros((len(self.ids), n), dtype=q.dtype)
        pairs = None
        for at in range(0, dims, DIM_BLOCK):
            to = min(at + DIM_BLOCK, dims)
            if pairs is None:
                score += q[:, at:to] @ columns[at:to]
                if to == dims:
                    break
                alive = score.astype(np.float64) + self.tails[:, to, None] * (tails[None, to] * SLACK) + margin >= self.floor[:, None]
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    x, y = np.nonzero(alive)
                    pairs, score = (x, y), score[x, y]
            else:
                x, y = pairs
                for d in range(at, to):
                    score += q[x, d] * columns[d, y]
                if to < dims:
                    alive = score.astype(np.float64) + self.tails[x, to] * (tails[to, y] * SLACK) + margin >= self.floor[x]
                    pairs, score = (x[alive], y[alive]), score[alive]
        if pairs is None:
            pairs = np.nonzero(score.astype(np.float64) >= self.floor[:, None])
            score = score[pairs]
        x, y = pairs
        own = ids[y] != self.ids[x]
        good = own & (score.astype(np.float64) >= self.floor[x])
        x, y, score = x[good], y[good], score[good].astype(np.int64)
        bounds = np.searchsorted(x, np.arange(len(self.ids) + 1))
        for r in np.unique(x):
            s, e = bounds[r], bounds[r + 1]
            ss, ii = np.concatenate([self.best[r][0], score[s:e]]), np.concatenate([self.best[r][1], ids[y[s:e]]])
            order = np.lexsort((ii, -ss))[: self.k]
            self.best[r] = ss[order], ii[order]
            if len(order) == self.k:
                self.floor[r] = ss[order[-1]]


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query, all if fewer.

    Components are floor(scale * x) and scores exact at any size; a component, or
    the score of a pair that isn't ruled out, that no long holds raises an error
    (as it does in SQL).  ``is_query`` is a condition on the id
    column; every row but those of the query's own id is a candidate.  Ties go
    to the smaller id, repeated rows (same id) are listed row by row.  A vector
    that is null, or has a null or non-finite component, and a null id take no
    part; vectors of another length than the query's have no score with it.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, id_col, vector_col, scale).withColumn("d", F.size("v")), "vectors")
    asked = rows.where(is_query(F.col("id")))
    n, m = rows.count(), asked.count()
    # Query blocks meet candidate blocks in a grid, each cell one bounded group;
    # every row goes once to each block of the other kind.
    q_blocks, c_blocks = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(q_blocks, min(cells, -(-m // TILE))) if c_blocks == 1 else q_blocks
    spread = lambda df, mine, there, kind: df.select("id", "v", "d", F.lit(kind).alias("kind"), mine.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(there - 1))).alias("other"))
    queries = spread(asked, F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"), c_blocks, 0).select("kind", "id", "v", "d", F.col("own").alias("qb"), F.col("other").alias("cb"))
    candidates = spread(rows, F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(c_blocks)).cast("int"), q_blocks, 1).select("kind", "id", "v", "d", F.col("other").alias("qb"), F.col("own").alias("cb"))
    grid = queries.unionByName(candidates).repartition(q_blocks * c_blocks, "qb", "cb", "d").sortWithinPartitions("qb", "cb", "d", "kind")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(batch.num_rows, -1).astype(np.int64)

    def result(tiles: list[Tile]) -> Iterator[pa.RecordBatch]:
        for t in tiles:
            n = [len(s) for s, _ in t.best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.ids, n)), pa.array(np.concatenate([i for _, i in t.best])), pa.array(np.concatenate([s for s, _ in t.best]))], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tiles, asked_ids, asked_rows = None, [], [], []
        for whole in batches:
            if not whole.num_rows:
                continue
            keys = [whole.column(j).to_numpy(zero_copy_only=False) for j in (4, 5, 3, 0)]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                part, here = whole.slice(s, e - s), tuple(int(x[s]) for x in keys[:3])
                if here != cell:
                    yield from result(tiles)
                    cell, tiles, asked_ids, asked_rows = here, [], [], []
                ids, values = part.column(1).to_numpy(), matrix(part)
                if keys[3][s] == 0:
                    asked_ids.append(ids)
                    asked_rows.append(values)
                    continue
                if asked_ids:
                    ids_q, q = np.concatenate(asked_ids), np.concatenate(asked_rows)
                    tiles = [Tile(ids_q[t : t + TILE], q[t : t + TILE], k) for t in range(0, len(ids_q), TILE)]
                    asked_ids, asked_rows = [], []
                if not tiles:
                    continue
                for c in range(0, len(ids), CHUNK):
                    columns = np.ascontiguousarray(values[c : c + CHUNK].T)
                    tails = tails_of(columns)
                    for t in tiles:
                        t.scan(ids[c : c + CHUNK], columns, tails)
        yield from result(tiles)

    found = arrow_map(grid.select("kind", "id", "v", "d", "qb", "cb"), run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda x: x % 20 == 0)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
