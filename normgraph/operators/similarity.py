"""Cosine similarity joins by blocks.

Rows are dealt to blocks of bounded size; each pair of blocks meets in one cell,
and a cell is one matrix product.  Neither the matrix of all pairs nor a
cartesian product is ever built.

A join with a threshold deals rows by pivots: a block holds a ring of angles
around the pivot nearest to its rows, and it is known between which angles its
rows lie from every pivot.  By the triangle inequality two blocks whose angles
from any pivot are further apart than the threshold allows hold no pair, so
their cell is never shuffled.  Where all pairs count (percentiles) and where
there is one cell anyway, blocks are dealt by a hash of the id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.storage import materialize

#: Rows of a block where there are few, and of the largest one; a cell holds two blocks.  Of very many rows blocks are larger, since a row goes to as many cells as there are blocks.
BLOCK, LARGEST = 2048, 8192
#: Blocks of a side for each root of the number of tasks, from which on blocks become larger; scores of a cell that are worked out at once, and rows whose angles are.
SPREAD, SCORES, SLICE = 4, 1 << 21, 1024
#: Pivots of a side at most, and parts that the angles around one are counted in: the driver gets PIVOTS * RINGS rows at most.
PIVOTS, RINGS = 512, 64
#: Sampled rows for each pivot, and bytes of all blocks' angles that are broadcast: with very many blocks there are fewer pivots.
SAMPLED, ANGLE_BYTES = 16, 64 << 20
#: More than the rounding error of an angle, in radians.
ANGLE_ERROR = 1e-6

# Thresholds of the four edge kinds.
THRESHOLDS = {"intl": 0.70, "natl": 0.70, "cross": 0.55, "governs": 0.50}
#: Parts in which scores are counted, scores that are sorted at once, and more than a score's rounding error.
BINS, FEW_SCORES, ROUNDING = 1 << 14, 500_000, 1e-12


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b))
    return F.transform(x, lambda c: F.when(norm > 0, c / norm).otherwise(c))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-300))


@dataclass(frozen=True)
class Pairs:
    """What a similarity join compares.

    other = None is a self-join over ord < ord; ``cross_group`` asks for
    different groups.
    """

    left: DataFrame
    threshold: float
    right: DataFrame | None = None
    cross_group: bool = True


def kind_of(df: DataFrame) -> str:
    """What vectors are shuffled as: single numbers stay such, all others become double; products are double."""
    return "float" if df.schema["vector"].dataType.simpleString() == "array<float>" else "double"


def block_rows(df: DataFrame, rows: int) -> int:
    """Rows of a block, at most ``LARGEST``, that keep the blocks few, but leave several cells for each task."""
    blocks = math.ceil(SPREAD * math.sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return min(LARGEST, max(BLOCK, -(-rows // blocks)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def _rows(df: DataFrame) -> DataFrame:
    kind = kind_of(df)
    return df.select("ord", F.col("group").cast("string").alias("group"), F.transform(F.col("vector"), lambda x: x.cast(kind)).alias("vector")).where("ord IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")


def _blocks(df: DataFrame, size: int, single: bool) -> tuple[DataFrame, int]:
    n = 1 if single else max(1, -(-df.count() // size))
    return _rows(df).withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int")), n


@dataclass(frozen=True)
class Rings:
    """Between which angles from each pivot the rows of each block lie: (blocks, pivots)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def met_by(self, other: Rings, block: int, limit: float) -> np.ndarray:
        """Blocks of this side that may hold a row within the angle ``limit`` of one in ``other``'s ``block``; both have the same pivots."""
        apart = np.maximum(self.low - other.high[block], other.low[block] - self.high)
        return np.flatnonzero(apart.max(axis=1, initial=0.0) <= limit + ANGLE_ERROR)


def _pivots(sample: np.ndarray, wanted: int, rounds: int = 3) -> np.ndarray:
    """At most ``wanted`` directions that lie amid the sample's."""
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < wanted and nearest.min() < 1 - ANGLE_ERROR:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    pivots = sample[chosen]
    for _ in range(rounds):
        own = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > ANGLE_ERROR, sums / np.maximum(norms, ANGLE_ERROR), pivots)
    # each by the one most like it that is left: small neighbours share blocks
    order, left = [0], np.arange(1, len(pivots))
    while len(left):
        k = int((pivots[left] @ pivots[order[-1]]).argmax())
        order.append(int(left[k]))
        left = np.delete(left, k)
    return pivots[order]


@dataclass(frozen=True)
class Dealt:
    """One side of a join: its rows (ord, group, vector, block) and what the blocks are."""

    rows: DataFrame
    rings: Rings

    def with_blocks_of(self, other: Dealt) -> Dealt:
        """Both sides' rows, which have the same pivots; ``other``'s blocks are numbered on."""
        rows = self.rows.unionByName(other.rows.withColumn("block", F.col("block") + F.lit(len(self.rings.low))))
        return Dealt(rows, Rings(self.rings.pivots, *(np.concatenate([getattr(self.rings, c), getattr(other.rings, c)]) for c in ("low", "high"))))


def _angles(vectors: pa.ListArray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, angles from every pivot) of the rows of the pivots' dimension that aren't zero."""
    own = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == (pivots.shape[1] if len(pivots) else -1))
    if not len(own):
        return own, np.empty((0, len(pivots)))
    rows = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
    norms = np.linalg.norm(rows, axis=1)
    some = norms > 0
    return own[some], np.arccos(np.clip((rows[some] / norms[some, None]) @ pivots.T, -1, 1))


def dealt(df: DataFrame, size: int = BLOCK, pivots: np.ndarray | None = None) -> Dealt:
    """A side's rows by pivots and rings, written.

    Without ``pivots`` they come from a bounded sample, the rows of the smallest
    hashes: far apart at first, then the middles of the sample's rows around
    them.  A join's result doesn't depend on them.  Rows of another dimension
    than the pivots, and zero rows, may meet every block.
    """
    spark, rows = df.sparkSession, _rows(df)
    if pivots is None:
        n = rows.count()
        wanted = int(min(PIVOTS, max(1, 2 * n // size), max(1, ANGLE_BYTES // (8 * (1 + n // size)))))
        sample = rows.where(F.exists("vector", lambda x: x != 0)).select("vector", F.xxhash64("ord").alias("h"), "ord").orderBy("h", "ord").limit(SAMPLED * wanted).collect()
        pivots = _pivots(np.array([r.vector for r in sample if len(r.vector) == len(sample[0].vector)], float), wanted) if sample else np.empty((0, 0))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            pivot, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            own, angles = _angles(batch.column(2), pivots)
            if len(own):
                pivot[own], angle[own] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(angle)], names=["ord", "group", "vector", "pivot", "angle"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in _slices(batches):
            block = batch.column(3).to_numpy()
            own, angles = _angles(batch.column(2), pivots)
            low, high = np.zeros((batch.num_rows, len(pivots))), np.full((batch.num_rows, len(pivots)), np.pi)
            low[own] = high[own] = angles
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for b, x, y in zip(block[order][cuts].tolist(), np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)) if len(cuts) else ():
                had = found.setdefault(b, [x, y])
                found[b] = [np.minimum(had[0], x), np.maximum(had[1], y)]
        at = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([found[b][k].tolist() for b in at], pa.list_(pa.float64())) for k in (0, 1))], names=["block", "low", "high"])

    ring = F.least(F.floor(F.col("angle") / np.pi * RINGS), F.lit(RINGS - 1)).cast("int")
    near = materialize(rows.mapInArrow(nearest, f"ord long, group string, vector array<{kind_of(rows)}>, pivot int, angle double").withColumn("ring", ring), "near-pivots")
    places, blocks, before, room = [], 0, -1, 0
    counted = sorted(near.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n")).collect())
    of_pivot = Counter()
    for r in counted:
        of_pivot[r.pivot] += r.n
    for r in counted:
        # with the ring before it in one block, or with its whole pivot in the block of the pivot before
        if before >= 0 and (r.n if before == r.pivot else of_pivot[r.pivot]) <= room:
            places.append((r.pivot, r.ring, blocks - 1, 1))
            room -= r.n
        else:  # a ring of very many rows is dealt by a hash
            parts = -(-r.n // size)
            places.append((r.pivot, r.ring, blocks, parts))
            blocks, room = blocks + parts, size - r.n if parts == 1 else 0
        before = r.pivot
    table = spark.createDataFrame(places, "pivot int, ring int, first int, parts int")
    placed = near.join(F.broadcast(table), ["pivot", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("ord"), F.col("parts"))).cast("int")).select("ord", "group", "vector", "block")
    together = materialize(placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block"), "blocks")
    low, high = np.full((blocks, len(pivots)), np.pi), np.zeros((blocks, len(pivots)))
    for r in together.mapInArrow(bounds, "block int, low array<double>, high array<double>").toLocalIterator():  # a row for each block, and for each that a split cuts
        low[r.block], high[r.block] = np.minimum(low[r.block], r.low), np.maximum(high[r.block], r.high)
    return Dealt(together, Rings(pivots, low, high))


def _with_partners(rows: DataFrame, own: Rings, others: Rings, limit: float) -> DataFrame:
    """``rows`` once for each block of the other side that their own may meet, as ``partner``."""
    shared = rows.sparkSession.sparkContext.broadcast((own, others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = shared.value
        known: dict[int, list[int]] = {}
        for batch in batches:
            blocks = batch.column(3).to_pylist()
            for b in set(blocks) - known.keys():
                known[b] = theirs.met_by(mine, b, limit).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[b] for b in blocks], pa.list_(pa.int32()))], names=["ord", "group", "vector", "block", "partners"])

    found = rows.mapInArrow(run, f"ord long, group string, vector array<{kind_of(rows)}>, block int, partners array<int>")
    return found.select("ord", "group", "vector", "block", F.explode("partners").alias("partner"))


def _limit(threshold: float) -> float:
    return float(np.arccos(np.clip(threshold, -1, 1)))


def _cells_by_pivots(left: Dealt, right: Dealt | None, threshold: float) -> DataFrame:
    """(p, q, side, ord, group, vector) of the cells that may hold a pair of that threshold."""
    limit, a = _limit(threshold), left.rings
    if right is None:
        # both ends decide alike, so each unordered pair of blocks comes once
        spread = _with_partners(left.rows, a, a, limit)
        return spread.select(F.least("block", "partner").alias("p"), F.greatest("block", "partner").alias("q"), F.when(F.col("block") <= F.col("partner"), 0).otherwise(1).alias("side"), "ord", "group", "vector")
    b = right.rings
    first = _with_partners(left.rows, a, b, limit).select(F.col("block").alias("p"), F.col("partner").alias("q"), F.lit(0).alias("side"), "ord", "group", "vector")
    return first.unionByName(_with_partners(right.rows, b, a, limit).select(F.col("partner").alias("p"), F.col("block").alias("q"), F.lit(1).alias("side"), "ord", "group", "vector"))


def cell_counts(left: Dealt, right: Dealt | None, threshold: float) -> tuple[int, int]:
    """(cells met, cells skipped) of the join of two sides, or of one with itself."""
    limit, alone, spark = _limit(threshold), right is None, left.rows.sparkSession
    a, b = left.rings, left.rings if alone else right.rings
    shared = spark.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = shared.value
        for batch in batches:
            met = [int(np.count_nonzero(theirs.met_by(mine, k, limit) >= (k if alone else 0))) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64())], names=["met"])

    n, m = len(a.low), len(b.low)
    met = spark.range(n).mapInArrow(run, "met long").agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
    return met, (n * (n + 1) // 2 if alone else n * m) - met


def _cells_by_hash(pairs: Pairs, block: int, single: bool = False) -> DataFrame:
    """(p, q, side, ord, group, vector) of all cells, or of the one that there is."""
    left, n = _blocks(pairs.left, block, single)
    if pairs.right is None:
        # each unordered pair of blocks once
        spread = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return spread.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "ord", "group", "vector")
    right, m = _blocks(pairs.right, block, single)
    a = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(F.col("block").alias("p"), "q", F.lit(0).alias("side"), "ord", "group", "vector")
    b = right.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("p", F.col("block").alias("q"), F.lit(1).alias("side"), "ord", "group", "vector")
    return a.unionByName(b)


def _by_cells(cells: DataFrame, alone: bool, cross: bool, kernel: Callable, schema: str) -> DataFrame:
    """What ``kernel`` makes of the cells.

    ``kernel()`` is called once a task and gives two functions: one takes a
    cell's scores, which of them are candidate pairs, and the ords of both
    sides; one is called at the end.  Both return a record batch or None.
    """
    spark = cells.sparkSession
    ordered = cells.withColumn("d", F.size("vector")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p", "q", "d").sortWithinPartitions("p", "q", "d")

    def product(meet: Callable, p: int, q: int, side, ids, groups, rows) -> Iterator[pa.RecordBatch | None]:
        first, second = side == 0, (side == 0 if alone and p == q else side == 1)
        if not first.any() or not second.any():
            return
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
        left, right, b = rows[first], rows[second].T, ids[second]
        if cross:
            # a null group differs from every group but another null one
            number: dict = {}
            group = np.array([number.setdefault(x, len(number)) for x in groups])
            mine, theirs = group[first], group[second]
        step = max(1, SCORES // len(b))
        for low in range(0, len(left), step):
            a = ids[first][low : low + step]
            keep = np.ones((len(a), len(b)), bool)
            if alone:
                keep &= a[:, None] < b if p == q else a[:, None] != b
            if cross:
                keep &= mine[low : low + step, None] != theirs
            yield meet(left[low : low + step] @ right, keep, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept = None, []
        meet, finish = kernel()

        def close() -> Iterator[pa.RecordBatch]:
            if kept:
                side, ids, groups, rows = (np.concatenate(x) for x in zip(*kept))
                kept.clear()
                yield from (x for x in product(meet, cell[0], cell[1], side, ids, groups, rows.astype(float)) if x is not None)

        for whole in batches:
            if not whole.num_rows:
                continue
            keys = [whole.column(k).to_numpy() for k in (0, 1, 6)]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                here, part = tuple(int(x[s]) for x in keys), whole.slice(s, e - s)
                if here != cell:
                    yield from close()
                    cell = here
                rows = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                kept.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False), rows))
        yield from close()
        last = finish()
        if last is not None:
            yield last

    return ordered.select("p", "q", "side", "ord", "group", "vector", "d").mapInArrow(run, schema)


def similar_pairs(pairs: Pairs, block: int | None = None) -> DataFrame:
    """(src, dst, score) by ord: pairs with cosine >= threshold.

    Inputs have ord (unique long), group and vector.  Rows with a null ord or
    vector, or a null in it, take no part; vectors of different lengths are
    never compared; zero vectors have similarity 0 with everything.
    """
    alone = pairs.right is None
    block = block or block_rows(pairs.left, max(side.count() for side in (pairs.left, pairs.right) if side is not None))
    if all(side is None or side.limit(block + 1).count() <= block for side in (pairs.left, pairs.right)):
        return _scored(_cells_by_hash(pairs, block, single=True), alone, pairs.cross_group, pairs.threshold)
    left = dealt(pairs.left, block)
    return dealt_pairs(left, None if alone else dealt(pairs.right, block, left.rings.pivots), pairs.threshold, pairs.cross_group)


def dealt_pairs(left: Dealt, right: Dealt | None, threshold: float, cross_group: bool = True) -> DataFrame:
    """``similar_pairs`` of sides that have been dealt to blocks by the same pivots."""
    return _scored(_cells_by_pivots(left, right, threshold), right is None, cross_group, threshold)


def _scored(cells: DataFrame, alone: bool, cross: bool, threshold: float) -> DataFrame:
    def kernel():
        def meet(score, keep, a, b):
            i, j = np.nonzero((score >= threshold) & keep)
            if not len(i):
                return None
            src, dst = (np.minimum(a[i], b[j]), np.maximum(a[i], b[j])) if alone else (a[i], b[j])
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(score[i, j])], names=["src", "dst", "score"])

        return meet, lambda: None

    return _by_cells(cells, alone, cross, kernel, "src long, dst long, score double")


def pair_percentile(pairs: Pairs, spec: str, block: int | None = None, few: int = FEW_SCORES) -> float:
    """``pNN`` of the scores of all candidate pairs (linear interpolation); the threshold of ``pairs`` isn't looked at.

    Scores are counted in bins inside the cells and the bins of the two ranks
    refined, until few scores are left to be sorted; pairs are never written out.
    """
    share = float(spec.lstrip("p")) / 100
    block = block or block_rows(pairs.left, max(side.count() for side in (pairs.left, pairs.right) if side is not None))
    cells, sides = _cells_by_hash(pairs, block), (pairs.right is None, pairs.cross_group)

    def counts(low: float, high: float) -> tuple[int, np.ndarray]:
        """Scores in all and in each of BINS equal parts; what lies beyond counts in the first and last."""

        def kernel():
            total = np.zeros(BINS, np.int64)

            def meet(score, keep, a, b):
                x = score[keep]
                x = x[~np.isnan(x)]
                at = np.clip((x - low) * (BINS / (high - low)), 0, BINS - 1).astype(np.int64)
                total[:] += np.bincount(at, minlength=BINS)

            def finish():
                k = np.flatnonzero(total)
                return pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["bin", "n"]) if len(k) else None

            return meet, finish

        found = _by_cells(cells, *sides, kernel, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(BINS, np.int64)
        for r in found:
            total[r.bin] = r.n
        return int(total.sum()), total

    def values_at(places: list[int], low: float, high: float, found: np.ndarray) -> dict[int, float]:
        """The scores of 0-based places in ascending order; ``found`` are the counts of [low, high]'s parts.  Each part is refined by itself."""
        at, width, out = np.searchsorted(np.cumsum(found), places, "right"), (high - low) / BINS, {}
        for k in np.unique(at).tolist():
            # a product may come out otherwise by a rounding error in the next pass
            own, least, most = [p for p, x in zip(places, at) if x == k], low + k * width - ROUNDING, low + (k + 1) * width + ROUNDING
            if found[k] <= few or most - least <= 16 * ROUNDING:
                out |= sorted_out(own, least, most)
            else:
                out |= values_at(own, least, most, counts(least, most)[1])
        return out

    def sorted_out(places: list[int], low: float, high: float) -> dict[int, float]:
        """The same in a range of at most ``few`` scores, or of such as differ by rounding only."""

        def kernel():
            below, seen = 0, []

            def meet(score, keep, a, b):
                nonlocal below
                x = score[keep]
                below += int(np.count_nonzero(x < low))
                seen.append(np.unique(x[(x >= low) & (x <= high)], return_counts=True))

            def finish():
                x, k = (np.concatenate(v) for v in zip(*seen)) if seen else (np.empty(0), np.empty(0, np.int64))
                return pa.RecordBatch.from_arrays([pa.array(np.append(x, float("-inf"))), pa.array(np.append(k, below))], names=["score", "n"])

            return meet, finish

        # in a range as narrow as rounding errors all scores count as its middle one
        rows = _by_cells(cells, *sides, kernel, "score double, n long")
        if high - low <= 16 * ROUNDING:
            rows = rows.withColumn("score", F.when(F.col("score") > float("-inf"), F.lit((low + high) / 2)).otherwise(F.col("score")))
        rows = rows.groupBy("score").agg(F.sum("n").alias("n")).toPandas().sort_values("score")
        upto, scores = np.cumsum(rows.n.to_numpy()), rows.score.to_numpy()
        return {p: float(scores[np.searchsorted(upto, p, "right")]) for p in places}

    low, high = -1.0 - ROUNDING, 1.0 + ROUNDING
    n, found = counts(low, high)
    if not n:
        return 0.0
    place = share * (n - 1)
    ranks = sorted({int(np.floor(place)), int(np.ceil(place))})
    value = values_at(ranks, low, high, found)
    x, y = value[ranks[0]], value[ranks[-1]]
    return x + (y - x) * (place - ranks[0])


def pair_statistics(groups: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: threshold, kept edges and candidate pairs (i < j in different groups).

    Candidates are counted from group sizes: all pairs less those within a group.
    """
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("k"))
    total = sizes.agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("within"))
    candidates = ((F.col("n") * (F.col("n") - 1) - F.col("within")) / 2).cast("long")
    return total.select(F.coalesce(candidates, F.lit(0)).alias("candidates")).crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("kept")))).select(F.lit(threshold).alias("threshold"), "kept", "candidates")


def threshold_sweep(pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n_pairs): pairs strictly above each threshold, in one pass."""
    counts = pairs.agg(*[F.coalesce(F.sum((F.col("score") > t).cast("long")), F.lit(0)).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("n_pairs")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")
