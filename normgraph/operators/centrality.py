"""Betweenness centrality.

Shortest paths are counted from each source level by level (Brandes).  A graph
of at most ``BROADCAST_EDGES`` adjacent pairs is broadcast and sources are dealt
to tasks.  A larger one never passes the driver: it is cut into biconnected
blocks, whose nodes weigh as much as what hangs on them.  Pairs that are parted
by a node follow from those weights alone; the others are counted inside blocks:
several small blocks in a task, a larger one with a batch of its sources each,
and one of more than ``BLOCK_PAIRS`` pairs by products of cells of it with
matrices of nodes and sources, level by level.

``betweenness_estimate`` samples pairs of nodes instead and stops as soon as all
nodes' estimates are within the asked error.  A pair's shortest paths are found
from both ends at once, so a sample looks at the neighbourhoods of two nodes,
not at the graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.model import Graph, few
from normgraph.operators.blocks import blocks
from normgraph.operators.ranking import global_rank
from normgraph.storage import materialize, settled

#: Adjacent pairs (both directions) of a graph that is broadcast: 4 MB.
BROADCAST_EDGES = 250_000
#: Adjacent pairs of a block that one task holds (about 100 MB), and of small blocks that share a task.
BLOCK_PAIRS, SHARED_PAIRS = 2_000_000, 65_536
#: Pairs that a task walks along, over all of its sources.
STEPS = 600_000_000
#: Sources that a task searches from at once, levels up to which it does, and numbers that it adds up at a time.
TOGETHER, LEVELS, ADDED = 32, 12, 1 << 17
#: How many numbers of whole rows are added up in the time of a single one.
SINGLE = 4
#: Nodes of a part of a very large block, and sources of a batch there: such a matrix takes 16 MB.
PART, SOURCES = 16_384, 128
#: Parts of a square's side, whose cells meet the matrices of its parts in one task; batches of sources that do so together, and pairs that are dealt to cells at once.
SIDE, BATCHES, DEALT = 4, 4, 1 << 20
#: Numbers of a matrix that tell whether it has few values.
TRIED = 4_096
#: Rows of a frontier, or of all nodes' numbers, that are broadcast to the pairs they are joined with.
FRONTIER_ROWS = 200_000
#: Sources that the dashboard's convention starts from.
DASHBOARD_SOURCES = 200


def adjacent_pairs(graph: Graph, multi: bool) -> DataFrame:
    """(u, v) by node ord, both directions; parallel edges stay if ``multi``."""
    e = graph.numbered().select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v")
    e = e if multi else e.distinct()
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")


def _added(out: np.ndarray, u: np.ndarray, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``out`` with the ``rows`` of u added up by v, which ascends."""
    step = max(1, ADDED // rows.shape[1])
    for low in range(0, len(u), step):
        x, y = u[low : low + step], v[low : low + step]
        first = np.flatnonzero(np.diff(y.astype(np.int64), prepend=-1))
        out[y[first]] += np.add.reduceat(rows[x], first, axis=0)
    return out


class _Lists:
    """What the pairs (u, v), v ascending, lead from and to: ``came(k)`` and ``go(k)`` are starts and other ends of the lists of all nodes v and u."""

    def __init__(self, u: np.ndarray, v: np.ndarray, nodes: int, to: int):
        self.u, self.v, self.nodes = u, v, nodes
        self.ins, self.outs = np.bincount(v, minlength=to), np.bincount(u, minlength=nodes)
        self._go = None

    def came(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.ins) - self.ins, self.u

    def go(self) -> tuple[np.ndarray, np.ndarray]:
        if self._go is None:
            order = np.argsort(self.u.astype(np.uint16) if self.nodes <= 1 << 16 else self.u, kind="stable")
            self._go = np.cumsum(self.outs) - self.outs, self.v[order]
        return self._go


def _listed(first: np.ndarray, ends: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The ``counts`` ends of each of ``nodes``, about ``ADDED`` at once: which nodes, their counts and their ends."""
    upto, low = np.cumsum(counts), 0
    while low < len(nodes):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - counts[low] + ADDED, "right")))
        here = counts[low:high]
        yield slice(low, high), here, ends[np.arange(here.sum()) + np.repeat(first[nodes[low:high]] - (np.cumsum(here) - here), here)]
        low = high


def _along(u: np.ndarray, v: np.ndarray, rows: np.ndarray, to: np.ndarray, lists: _Lists | None = None) -> np.ndarray:
    """The sums of ``rows`` over the pairs (v ascends) into the places ``to``.

    Where few numbers of ``rows`` aren't 0, each goes along its node's pairs;
    where few places are asked for, each takes what its node's pairs bring.
    Otherwise whole rows are added up, over pairs that lead from a row with
    anything to a node with such a place.  Matrices are turned for single
    numbers, so that those of one source lie together.
    """
    if lists is None:
        lists = _Lists(u, v, len(rows), len(to))
    pushed, pulled = np.count_nonzero(rows, axis=1) @ lists.outs, np.count_nonzero(to, axis=1) @ lists.ins
    if min(pushed, pulled) * SINGLE >= len(u) * rows.shape[1]:
        on = rows.any(axis=1)[u] & to.any(axis=1)[v]
        return _added(np.zeros(to.shape), u[on], v[on], rows) * to
    turned, sums = np.ascontiguousarray(rows.T), np.zeros(to.shape[::-1])
    flat = sums.ravel()
    if pushed <= pulled:
        j, i = np.nonzero(turned)
        value = turned[j, i]
        for at, counts, ends in _listed(*lists.go(), i, lists.outs[i]):
            np.add.at(flat, np.repeat(j[at] * len(to), counts) + ends, np.repeat(value[at], counts))
        return sums.T * to
    j, i = np.nonzero(to.T)
    some = lists.ins[i] > 0
    j, i, values = j[some], i[some], turned.ravel()
    for at, counts, ends in _listed(*lists.came(), i, lists.ins[i]):
        flat[j[at] * len(to) + i[at]] = np.add.reduceat(values[np.repeat(j[at] * len(rows), counts) + ends], np.cumsum(counts) - counts)
    return sums.T


def _together(sources: np.ndarray, u: np.ndarray, v: np.ndarray, n: int, weight: np.ndarray, starts: np.ndarray | None, lists: _Lists) -> np.ndarray | None:
    """``_dependencies`` of few sources, all pairs once for each level; None where there are so many levels that a search from each costs less."""
    if not len(u):
        return np.zeros(n)
    one = np.arange(len(sources))
    depth, paths = np.full((n, len(sources)), -1), np.zeros((n, len(sources)))
    depth[sources, one], paths[sources, one] = 0, 1.0
    for level in range(LEVELS + 1):
        found = _along(u, v, np.where(depth == level, paths, 0.0), depth < 0, lists)
        new = found > 0
        if not new.any():
            break
        depth[new], paths[new] = level + 1, found[new]
    else:
        return None
    carried = np.zeros_like(paths)
    for k in range(level, 1, -1):
        share = np.divide(weight[:, None] + carried, paths, out=np.zeros_like(paths), where=depth == k)
        before = depth == k - 1
        carried = np.where(before, paths * _along(u, v, share, before, lists), carried)
    return carried.sum(axis=1) if starts is None else carried @ starts[sources]


def _dependencies(sources: np.ndarray, start: np.ndarray, ends: np.ndarray, n: int, weight: np.ndarray | float = 1.0, starts: np.ndarray | None = None) -> np.ndarray:
    """Sum over sources of what each node carries of their shortest paths; a node counts ``weight`` times as a target and ``starts`` times as a source."""
    total, weight = np.zeros(n), np.broadcast_to(weight, n)
    v = np.repeat(np.arange(n), np.diff(start))
    lists = _Lists(ends, v, n, n)
    while len(sources):
        together = _together(sources[:TOGETHER], ends, v, n, weight, starts, lists)
        if together is None:
            break
        total += together
        sources = sources[TOGETHER:]
    for s in sources:
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[s], paths[s] = 0, 1.0
        levels, level = [], np.array([s])
        while len(level):
            counts = start[level + 1] - start[level]
            u = np.repeat(level, counts)
            at = np.repeat(start[level] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            v = ends[at]
            new = depth[v] < 0
            depth[v[new]] = len(levels) + 1
            on = depth[v] == len(levels) + 1
            paths += np.bincount(v[on], weights=paths[u[on]], minlength=n)
            levels.append((u[on], v[on]))
            level = np.unique(v[new])
        carried = np.zeros(n)
        for u, v in reversed(levels):
            carried += np.bincount(u, weights=paths[u] / paths[v] * (weight[v] + carried[v]), minlength=n)
        carried[s] = 0
        total += carried if starts is None else carried * starts[s]
    return total


def _by_broadcast(spark, pairs: DataFrame, sources: DataFrame) -> DataFrame:
    rows = pairs.toArrow()  # at most BROADCAST_EDGES rows of two numbers, column by column
    names = np.unique(np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()]))
    u, v = (np.searchsorted(names, rows[c].to_numpy()).astype(np.int32) for c in ("u", "v"))
    del rows
    order = np.argsort(u, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(names)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((names, start, v[order]))
    del u, v, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, ends = shared.value
        for batch in batches:
            s = batch.column(0).to_numpy()
            at = np.searchsorted(names, s)
            known = (at < len(names)) & (names[np.minimum(at, max(len(names) - 1, 0))] == s) if len(names) else np.zeros(len(s), bool)
            total = _dependencies(at[known], start, ends, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["ord", "carried"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.repartition(parts, "ord").mapInArrow(run, "ord long, carried double").groupBy("ord").agg(F.sum("carried").alias("carried"))


def _shut(x: np.ndarray) -> bytes:
    """A matrix as the smallest kind of whole numbers that holds it, as places among its values if they are few, or as it is; compressed."""
    few_values = b""
    if x.size and (low := x.min()) >= 0 and (high := x.max()) < 1 << 32:
        small = np.min_scalar_type(int(high))
        if x.dtype.kind != "f":
            x = x.astype(small)
        elif np.array_equal(x, whole := x.astype(small)):
            x = whole
    if x.dtype.kind == "f" and len(np.unique(x.ravel()[:TRIED])) * 2 < min(TRIED, x.size):
        some = np.unique(x)
        if len(some) <= 1 << 16:
            few_values = len(some).to_bytes(4, "little") + some.astype(np.float64).tobytes()
            x = np.searchsorted(some, x).astype(np.uint8 if len(some) <= 1 << 8 else np.uint16)
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + x.dtype.str.encode() + len(few_values).to_bytes(4, "little") + few_values + pa.Codec("zstd").compress(data, asbytes=True)


def _open(data: pa.Scalar, columns: int, kind=np.float64) -> np.ndarray:
    data = memoryview(data.as_buffer())
    start = 15 + int.from_bytes(data[11:15], "little")
    found = pa.Codec("zstd").decompress(data[start:], int.from_bytes(data[:8], "little"), asbytes=True)
    found = np.frombuffer(found, np.dtype(bytes(data[8:11]).decode())).reshape(-1, columns)
    return np.frombuffer(data[19:start], np.float64)[found].astype(kind, copy=False) if start > 15 else found.astype(kind)


def _binary(*values: bytes | None) -> pa.Array:
    return pa.array(values, pa.binary())


def _cell(u: np.ndarray, v: np.ndarray, size: int) -> bytes:
    """Pairs by v and u as gaps between their places among all pairs of two parts, all first bytes before all second ones, compressed."""
    gaps = np.diff(np.sort(v.astype(np.int64) * size + u), prepend=0)
    kind = np.min_scalar_type(int(gaps.max()))
    data = np.ascontiguousarray(gaps.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return len(gaps).to_bytes(8, "little") + kind.str.encode() + pa.Codec("zstd").compress(data, asbytes=True)


def _of_cell(data: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = memoryview(data.as_buffer())
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(bytes(data[8:11]).decode())
    found = np.frombuffer(pa.Codec("zstd").decompress(data[11:], n * kind.itemsize, asbytes=True), np.uint8)
    v, u = np.divmod(np.cumsum(np.ascontiguousarray(found.reshape(kind.itemsize, n).T).view(kind).ravel(), dtype=np.int64), size)
    return u, v


def _by_parts(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, carried) of the same sums, level by level, no task holding a whole graph.

    ``pairs`` (u, v) are both directions, ``nodes`` has ord, weight and starts
    (0: no source).  Nodes are numbered and dealt to parts by number, pairs to
    cells of two parts (both directions in one), sources to batches; what is
    known of a part's nodes from a batch's sources is a matrix, and a level is a
    product of each cell with the matrices of its parts.  Cells lie together in
    squares, so that a matrix goes to few tasks.  Matrices of parts that a batch doesn't reach
    don't exist.  A product keeps the places that its level asks for: on the way
    out nodes not seen yet, on the way back those of the level before; so what
    is dealt is mostly zeros, and compressed.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(global_rank(nodes.withColumn("_all", F.lit(0)), F.col("_all"), "place").select("ord", "weight", "starts", (F.col("place") - 1).alias("place")), "numbered-nodes")
    n = placed.count()
    size = max(1, min(PART, -(-n // 3)))
    number = few(placed.select("ord", "place"))
    ends = pairs.where("u < v").join(number.withColumnsRenamed({"ord": "u", "place": "pu"}), "u").join(number.withColumnsRenamed({"ord": "v", "place": "pv"}), "v").select("pu", "pv")
    at = lambda c: ((F.col(c) / size).cast("long").cast("int"), (F.col(c) % size).cast("int"))
    across = -(-n // size)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def cells() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*kept))
            u, v = np.maximum(u, v), np.minimum(u, v)
            cell = v // size * across + u // size
            order = np.argsort(cell, kind="stable")
            u, v, cell = u[order], v[order], cell[order]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
            made = [_cell(u[s:e] % size, v[s:e] % size, size) for s, e in zip(cuts, [*cuts[1:], len(cell)])]
            p, q = np.divmod(cell[cuts], across)
            return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), _binary(*made)], names=["p", "q", "pairs"])

        for batch in batches:
            if batch.num_rows:
                kept.append([c.to_numpy() for c in batch.columns])
                rows += batch.num_rows
            if rows >= DEALT:
                yield cells()
                kept, rows = [], 0
        if kept:
            yield cells()

    def packed(cell: pa.Table) -> pa.Table:
        u, v = (np.concatenate(x) for x in zip(*(_of_cell(x, size) for x in cell["pairs"])))
        return pa.table({"p": cell["p"][:1], "q": cell["q"][:1], "pairs": _binary(_cell(u, v, size))})

    cells = "p int, q int, pairs binary"
    cells = materialize(ends.mapInArrow(dealt, cells).groupBy("p", "q").applyInArrow(packed, cells), "pair-cells")
    starting = placed.where("starts > 0")
    ranked = materialize(global_rank(starting.withColumn("_all", F.lit(0)), F.col("_all"), "source", "place").select("place", "starts", (F.col("source") - 1).alias("source")), "sources")
    sources = ranked.count()
    width = max(1, -(-sources // max(1, -(-sources // SOURCES))))
    schema = "b int, k int, depth binary, paths binary, new long"

    def rows_of(b: int) -> int:
        return min(size, n - b * size)

    def begin(rows: pa.Table) -> pa.Table:
        b, k = rows["b"][0].as_py(), rows["k"][0].as_py()
        depth, paths = np.zeros((rows_of(b), width), np.int32), np.zeros((rows_of(b), width))
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        depth[i, j], paths[i, j] = 1, 1.0
        return pa.table({"b": pa.array([b], pa.int32()), "k": pa.array([k], pa.int32()), "depth": _binary(_shut(depth)), "paths": _binary(_shut(paths)), "new": pa.array([len(i)], pa.int64())})

    # depths are kept as levels and one more; 0 is not seen
    b, i = at("place")
    state = materialize(ranked.select(b.alias("b"), i.alias("i"), (F.col("source") / width).cast("long").cast("int").alias("k"), (F.col("source") % width).cast("int").alias("j")).groupBy("b", "k").applyInArrow(begin, schema), "level")
    square = lambda c: (F.col(c) / SIDE).cast("int")
    squares = cells.select(square("p").alias("row"), square("q").alias("col")).distinct()
    ends = F.array(F.struct(F.col("row").alias("own"), F.col("col").alias("other")), F.struct(F.col("col").alias("own"), F.col("row").alias("other")))
    met = F.broadcast(squares.select(F.explode(F.array_distinct(ends)).alias("x")).select("x.*").groupBy("own").agg(F.collect_list("other").alias("others")))  # a number for each square

    def times(front: DataFrame) -> DataFrame:
        """(p, k, found): products of all cells with the matrices x of ``front`` (b, k, x, asked, asks), one row for each square, part and batch; asked are the places that a part asks for."""
        group = (F.col("k") / BATCHES).cast("int").alias("g")
        spread = front.withColumn("own", square("b")).join(met, "own").select("b", "own", "k", group, "x", "asked", F.explode("others").alias("other"))
        sated = F.broadcast(front.where("NOT asks").groupBy(square("b").alias("other"), "k").agg(F.count(F.lit(1)).alias("sated")))
        asks = F.coalesce("sated", F.lit(0)) < F.least(F.lit(SIDE), across - F.col("other") * SIDE)
        spread = spread.join(sated, ["other", "k"], "left").select(F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "g", "b", "k", F.when(asks, F.col("x")).alias("x"), "asked")
        groups = front.where("x IS NOT NULL").select(square("b").alias("own"), group).groupBy("own").agg(F.collect_set("g").alias("gs"))
        theirs = lambda end: F.broadcast(groups.withColumnsRenamed({"own": end, "gs": f"gs_{end}"}))
        known = cells.select(square("p").alias("row"), square("q").alias("col"), "p", "q", "pairs").join(theirs("row"), "row", "left").join(theirs("col"), "col", "left")
        none = F.array().cast("array<int>")
        known = known.select("row", "col", F.explode(F.array_union(F.coalesce("gs_row", none), F.coalesce("gs_col", none))).alias("g"), "p", "q", "pairs")

        def product(square: pa.Table, given: pa.Table) -> pa.Table:
            ps, ks, out = [], [], []
            has, asked = {}, {}
            for r, key in enumerate(zip(given["b"].to_pylist(), given["k"].to_pylist())):
                asked[key] = given["asked"][r]
                if given["x"][r].is_valid:
                    has.setdefault(key[0], []).append((key[1], given["x"][r]))
            firsts, seconds = square["p"].to_pylist(), square["q"].to_pylist()
            for o in sorted({*firsts, *seconds}):
                found, rows = {}, rows_of(o)
                for r, (p, q) in enumerate(zip(firsts, seconds)):
                    b = q if o == p else p
                    if o not in (p, q) or b not in has:
                        continue
                    u, v = _of_cell(square["pairs"][r], size)
                    if p == q:
                        u, v = np.concatenate([u, v]), np.concatenate([v, u])
                    elif o == q:
                        u, v = v, u
                    if o == q:
                        order = np.argsort(v.astype(np.uint16), kind="stable")
                        u, v = u[order], v[order]
                    lists = _Lists(u, v, rows_of(b), rows)
                    for k, x in has[b]:
                        to = np.unpackbits(_open(asked[o, k], 1, np.uint8).ravel(), count=rows * width).reshape(rows, width) > 0 if (o, k) in asked else np.ones((rows, width), bool)
                        if to.any():
                            new = _along(u, v, _open(x, width), to, lists)
                            found[k] = found[k] + new if k in found else new
                for k, x in found.items():
                    if x.any():
                        ps.append(o)
                        ks.append(k)
                        out.append(_shut(x))
            return pa.table({"p": pa.array(ps, pa.int32()), "k": pa.array(ks, pa.int32()), "found": pa.array(out, pa.binary())})

        return known.repartition(parts, "row", "col", "g").groupBy("row", "col", "g").cogroup(spread.groupBy("row", "col", "g")).applyInArrow(product, "p int, k int, found binary")

    def summed(rows: pa.Table, size: int) -> np.ndarray:
        total = np.zeros((size, width))
        for x in rows["found"]:
            total += _open(x, width)
        return total

    def front_of(state: DataFrame, level: int, weighted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1)
                    depth = _open(row["depth"][0], width, np.int32)
                    on, x = depth == level + 1, None
                    if on.any():
                        x = _open(row["paths"][0], width)
                        if weighted:
                            worth = _open(row["weight"][0], 1) + _open(row["carried"][0], width)
                            x = np.divide(worth, x, out=np.zeros_like(x), where=on)
                        x = _shut(np.where(on, x, 0.0))
                    to = depth == (level if weighted else 0)
                    yield pa.RecordBatch.from_arrays([row["b"], row["k"], _binary(x), _binary(_shut(np.packbits(to))), pa.array([bool(to.any())])], names=["b", "k", "x", "asked", "asks"])

        return materialize(state.mapInArrow(run, "b int, k int, x binary, asked binary, asks boolean"), "level-front")

    def onward(level: int) -> Callable:
        def run(had: pa.Table, rows: pa.Table) -> pa.Table:
            b, k = (had["b"], had["k"]) if had.num_rows else (rows["p"], rows["k"])
            size = rows_of(b[0].as_py())
            depth = _open(had["depth"][0], width, np.int32) if had.num_rows else np.zeros((size, width), np.int32)
            paths = _open(had["paths"][0], width) if had.num_rows else np.zeros((size, width))
            found = summed(rows, size)
            new = (depth == 0) & (found > 0)
            depth[new], paths[new] = level + 2, found[new]
            return pa.table({"b": b[:1], "k": k[:1], "depth": _binary(_shut(depth)), "paths": _binary(_shut(paths)), "new": pa.array([int(np.count_nonzero(new))], pa.int64())})

        return run

    level = 0
    while True:
        state = materialize(state.groupBy("b", "k").cogroup(times(front_of(state, level, False)).groupBy("p", "k")).applyInArrow(onward(level), schema), "level")
        if not state.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]:
            break
        level += 1

    def weights(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["i"].to_numpy())
        return pa.table({"b": rows["b"][:1], "weight": _binary(_shut(rows["weight"].to_numpy()[order].astype(float)))})

    of = materialize(placed.select(b.alias("b"), i.alias("i"), "weight").groupBy("b").applyInArrow(weights, "b int, weight binary"), "part-weights")

    def nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("carried", _binary(*[_shut(np.zeros((rows_of(x), width))) for x in batch["b"].to_pylist()]))

    schema = "b int, k int, depth binary, paths binary, weight binary, carried binary"
    state = state.select("b", "k", "depth", "paths").join(of, "b").mapInArrow(nothing, schema)

    def back(level: int) -> Callable:
        def run(had: pa.Table, rows: pa.Table) -> pa.Table:
            if not had.num_rows or not rows.num_rows:
                return had
            paths, carried = (_open(had[c][0], width) for c in ("paths", "carried"))
            on = _open(had["depth"][0], width, np.int32) == level
            carried = np.where(on, paths * summed(rows, len(paths)), carried)
            return had.drop_columns("carried").append_column("carried", _binary(_shut(carried)))

        return run

    while level > 1:
        state = materialize(state.groupBy("b", "k").cogroup(times(front_of(state, level, True)).groupBy("p", "k")).applyInArrow(back(level), schema), "level-back")
        level -= 1

    batches = ranked.groupBy((F.col("source") / width).cast("long").cast("int").alias("k")).agg(F.collect_list(F.struct((F.col("source") % width).cast("int").alias("j"), "starts")).alias("of"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                times = np.zeros(width)
                for x in batch["of"][r].as_py():
                    times[x["j"]] = x["starts"]
                total = _open(batch["carried"][r], width) @ times
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) + batch["b"][r].as_py() * size), pa.array(total)], names=["place", "carried"])

    sums = state.select("b", "k", "carried").join(batches, "k").mapInArrow(totals, "place long, carried double").groupBy("place").agg(F.sum("carried").alias("carried"))
    return number.join(sums, "place").select("ord", "carried")


def _inside_blocks(cell: pa.Table) -> pa.Table:
    """(ord, carried) of a task's blocks: rows are their pairs, and their nodes where v is null."""
    cell = cell.combine_chunks().sort_by("block")
    names, values = [], []
    if cell.num_rows:
        block, node = cell["block"].to_numpy(), cell["v"].is_null().to_numpy()
        batch, batches = cell["batch"][0].as_py(), cell["batches"][0].as_py()
        u, v, weight, starts = (cell[c].fill_null(0).to_numpy() for c in ("u", "v", "weight", "starts"))
        cuts = np.flatnonzero(np.diff(block)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(block)]):
            here, there = low + np.flatnonzero(node[low:high]), low + np.flatnonzero(~node[low:high])
            here = here[np.argsort(u[here])]
            known = u[here]
            a, b = np.searchsorted(known, u[there]), np.searchsorted(known, v[there])
            first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(known)))]).astype(np.int64)
            sources = np.flatnonzero(starts[here])[batch::batches]
            names.append(known)
            values.append(_dependencies(sources, first, b[np.argsort(a, kind="stable")], len(known), weight[here].astype(float), starts[here].astype(float)))
    return pa.table({"ord": pa.array(np.concatenate(names) if names else [], pa.int64()), "carried": pa.array(np.concatenate(values) if values else [], pa.float64())})


def _by_blocks(pairs: DataFrame, sources: DataFrame, block_pairs: int) -> DataFrame:
    """The same sums from biconnected blocks."""
    found = blocks(pairs, sources.select(F.col("ord").alias("node")))
    # sources beyond a node, seen from one of its blocks, times the targets that aren't on their side
    parted = found.members.select(F.col("node").alias("ord"), ((F.col("total_starts") - F.col("starts")).cast("double") * (F.col("weight") - 1)).alias("carried"))
    nodes = found.members.groupBy("block").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("starts") > 0).alias("sources")).where("nodes > 2")
    sizes = materialize(found.pairs.groupBy("block").agg(F.count(F.lit(1)).alias("size")).join(nodes, "block"), "block-sizes")
    small, large = F.col("size") <= min(SHARED_PAIRS, block_pairs), F.col("size") <= block_pairs
    told = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)), F.count_if(~large)).first()
    bins = -(-told[0] // SHARED_PAIRS) or 1
    dealt = sizes.where(large).select("block", F.when(small, -1 - F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")).alias("task"), F.when(small, F.lit(1)).otherwise(F.ceil(F.col("size") * F.col("sources") / STEPS).cast("int")).alias("batches"))
    none = F.lit(None).cast("long")
    rows = found.pairs.select("block", "u", "v", none.alias("weight"), none.alias("starts")).unionByName(found.members.select("block", F.col("node").alias("u"), none.alias("v"), "weight", "starts"))
    rows = rows.join(dealt, "block").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    sums = [parted, rows.groupBy("task", "batch").applyInArrow(_inside_blocks, "ord long, carried double")]
    if told[1]:
        # a node is another one in each of its blocks, so that no path leaves a block
        giant = sizes.where(~large).select("block")
        of = lambda x: F.struct("block", F.col(x).alias("node"))
        inner = found.pairs.join(giant, "block", "left_semi").select(of("u").alias("u"), of("v").alias("v"))
        inside = found.members.join(giant, "block", "left_semi").select(of("node").alias("ord"), F.col("weight").cast("double").alias("weight"), F.col("starts").cast("double").alias("starts"))
        sums.append(_by_parts(inner, inside).select(F.col("ord.node").alias("ord"), "carried"))
    whole = sums[0]
    for part in sums[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("ord").agg(F.sum("carried").alias("carried"))


def betweenness(graph: Graph, convention: str = "networkx", max_sources: int | None = DASHBOARD_SOURCES, broadcast_edges: int = BROADCAST_EDGES, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(id, ord, betweenness) of every node.

    ``networkx``: simple graph, all sources, each unordered pair once,
    normalised.  ``dashboard``: parallel edges count as paths of their own, only
    the first ``max_sources`` nodes are sources if there are more (scaled up;
    None: all of them are), and ordered pairs aren't halved.  Graphs of fewer than three nodes give 0.
    Bounds on what is broadcast and on what a task holds change no result.
    """
    if convention not in ("networkx", "dashboard"):
        raise ValueError(convention)
    n = graph.nodes.count()
    multi = convention == "dashboard"
    pairs = adjacent_pairs(graph, multi)
    if not multi:  # parallel edges are folded once
        pairs = materialize(pairs, "pairs")
    sources, scale = graph.nodes.select("ord"), 1.0
    some = multi and max_sources is not None and n > max_sources
    if some:
        sources, scale = sources.orderBy("ord").limit(max_sources), n / max_sources
    spark = graph.nodes.sparkSession
    if pairs.limit(broadcast_edges + 1).count() <= broadcast_edges:
        sums = _by_broadcast(spark, pairs, sources)
    elif some:  # searches from few sources cost less than finding the blocks
        nodes = graph.nodes.select("ord", F.lit(1.0).alias("weight")).join(F.broadcast(sources.withColumn("starts", F.lit(1.0))), "ord", "left").withColumn("starts", F.coalesce("starts", F.lit(0.0)))
        sums = settled(spark, "betweenness", lambda: _by_parts(pairs, nodes))
    else:
        sums = settled(spark, "betweenness", lambda: _by_blocks(pairs, sources, block_pairs))
    norm = scale / ((n - 1) * (n - 2) / 2 if multi else (n - 1) * (n - 2)) if n > 2 else 0.0
    return graph.nodes.join(sums, "ord", "left").select("id", "ord", (F.coalesce("carried", F.lit(0.0)) * norm).alias("betweenness"))


class _End:
    """One end of the drawn pairs: levels of (sample, node, paths) and the steps (sample, u, v) between them."""

    def __init__(self, draws: DataFrame, end: str, pairs: DataFrame):
        self.pairs, self.steps = pairs, []
        self.levels = [materialize(draws.select("sample", F.col(end).alias("node"), F.lit(1.0).alias("paths")), "pair-ends")]
        self.seen = self.levels[0].select("sample", "node")

    def go_on(self, active: DataFrame) -> bool:
        """The next level of the samples of ``active``; whether there is one."""
        front = self.levels[-1].join(active, "sample", "left_semi")
        few = front.limit(FRONTIER_ROWS + 1).count() <= FRONTIER_ROWS
        step = self.pairs.join(F.broadcast(front) if few else front.hint("merge"), F.col("u") == F.col("node")).select("sample", "u", "v", "paths")
        step = materialize(step.join(self.seen.withColumnRenamed("node", "v"), ["sample", "v"], "left_anti"), "pair-steps")
        level = materialize(step.groupBy("sample", F.col("v").alias("node")).agg(F.sum("paths").alias("paths")), "pair-level")
        self.steps.append(step.select("sample", "u", "v"))
        self.levels.append(level)
        self.seen = self.seen.unionByName(level.select("sample", "node"))
        return not level.isEmpty()

    def back(self, shares: DataFrame, depth: int) -> list[DataFrame]:
        """Shares of the nodes of all levels below ``depth``, from those of the nodes there."""
        out = []
        for k in range(depth - 1, 0, -1):
            below = shares.join(self.levels[k + 1].withColumnRenamed("paths", "pv"), ["sample", "node"]).select("sample", F.col("node").alias("v"), "share", "pv")
            step = self.steps[k].join(below, ["sample", "v"]).withColumnRenamed("u", "node").join(self.levels[k], ["sample", "node"])
            shares = materialize(step.groupBy("sample", "node").agg(F.sum(F.col("share") * F.col("paths") / F.col("pv")).alias("share")), "pair-shares")
            out.append(shares)
        return out


def pair_dependencies(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    """(sample, node, share): which share of a drawn pair's shortest paths runs through a node.

    ``pairs`` has adjacent (u, v) in both directions, ``draws`` (sample, s, t)
    with s <> t.  Ends don't count; a pair without a path has no rows.
    """
    return settled(draws.sparkSession, "pair-dependencies", lambda: _pair_dependencies(pairs, draws))


def _pair_dependencies(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    ends = _End(draws, "s", pairs), _End(draws, "t", pairs)
    active, found = draws.select("sample"), []
    for turn in range(2**31):
        if not ends[turn % 2].go_on(active):
            break
        a, b = (len(e.levels) - 1 for e in ends)
        # all shortest paths of a pair whose levels meet for the first time run through the nodes where they do
        meet = ends[0].levels[a].join(ends[1].levels[b].withColumnRenamed("paths", "others"), ["sample", "node"]).join(active, "sample", "left_semi")
        whole = meet.groupBy("sample").agg(F.sum(F.col("paths") * F.col("others")).alias("whole"))
        shares = materialize(meet.join(whole, "sample").select("sample", "node", (F.col("paths") * F.col("others") / F.col("whole")).alias("share")), "pair-meetings")
        found += [shares, *ends[0].back(shares, a), *ends[1].back(shares, b)]
        active = materialize(active.join(shares.select("sample").distinct(), "sample", "left_anti"), "pair-active")
        if active.isEmpty():
            break
    every = found[0] if found else draws.select("sample", F.col("s").alias("node"), F.lit(0.0).alias("share")).limit(0)
    for part in found[1:]:
        every = every.unionByName(part)
    return every.join(draws.select("sample", F.explode(F.array("s", "t")).alias("node")), ["sample", "node"], "left_anti")


def _half_width(samples: int, variance: float, chance: float) -> float:
    """How far a mean of ``samples`` shares may lie from the expected one but with probability ``chance``: the better of two bounds (each gets half of it), Hoeffding's and the empirical Bernstein one."""
    hoeffding = math.sqrt(math.log(4 / chance) / (2 * samples))
    bernstein = math.sqrt(2 * variance * math.log(8 / chance) / samples) + 7 * math.log(8 / chance) / (3 * (samples - 1))
    return min(hoeffding, bernstein)


def betweenness_estimate(graph: Graph, error: float = 0.05, confidence: float = 0.9, seed: int = 0, batch: int = 1024) -> DataFrame:
    """(id, ord, betweenness, error, samples) of every node.

    Pairs of nodes are drawn until, with probability ``confidence`` at least, no
    node's estimate is further than ``error`` from the ``networkx`` betweenness.
    Batches double; the k-th look takes 1 / (k (k + 1)) of the chance to err, so
    looking again and again costs nothing.  The columns error and samples say
    what was reached.  Fewer than three nodes give 0.
    """
    spark = graph.nodes.sparkSession
    n = graph.nodes.count()
    if n < 3:
        return graph.nodes.select("id", "ord", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("samples"))

    def sampled() -> DataFrame:
        pairs = materialize(adjacent_pairs(graph, False), "pairs")
        places = materialize(global_rank(graph.nodes.select("ord", F.lit(0).alias("all")), F.col("all"), "place").select("ord", "place"), "places")
        draw, samples, sums, look = np.random.RandomState(seed), 0, None, 0
        while True:
            look += 1
            size = max(batch, samples)
            first = draw.randint(0, n, size)
            second = (first + 1 + draw.randint(0, n - 1, size)) % n
            drawn = spark.createDataFrame([(samples + k, int(a) + 1, int(b) + 1) for k, (a, b) in enumerate(zip(first, second))], "sample long, a long, b long")
            ends = F.broadcast(drawn.select("sample", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("a").alias("place")), F.struct(F.lit("t").alias("end"), F.col("b").alias("place")))).alias("x")).select("sample", "x.*"))
            draws = materialize(places.join(ends, "place").groupBy("sample").agg(*[F.max(F.when(F.col("end") == x, F.col("ord"))).alias(x) for x in ("s", "t")]), "draws")
            new = pair_dependencies(pairs, draws).groupBy(F.col("node").alias("ord")).agg(F.sum("share").alias("one"), F.sum(F.col("share") * F.col("share")).alias("two"))
            sums = materialize(new if sums is None else sums.unionByName(new).groupBy("ord").agg(F.sum("one").alias("one"), F.sum("two").alias("two")), "sums")
            samples += size
            variance = sums.agg(F.coalesce(F.max((F.col("two") - F.col("one") * F.col("one") / samples) / (samples - 1)), F.lit(0.0))).first()[0]
            # shares are of n (n - 1) ordered pairs, betweenness is of the (n - 1) (n - 2) that a node is no end of
            reached = _half_width(samples, max(variance, 0.0), (1 - confidence) / (look * (look + 1)) / n) * n / (n - 2)
            if reached <= error:
                return sums.select("ord", (F.col("one") / samples * n / (n - 2)).alias("betweenness"), F.lit(reached).alias("error"), F.lit(samples).cast("long").alias("samples"))

    found = settled(spark, "betweenness-estimate", sampled)
    said = found.select("error", "samples").limit(1).collect()
    reached, samples = said[0] if said else (error, 0)
    return graph.nodes.join(found.select("ord", "betweenness"), "ord", "left").select("id", "ord", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.lit(reached).alias("error"), F.lit(samples).cast("long").alias("samples"))
