"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first (a hash) places a shingle
in one of SLOTS slots, the second is a fixed permutation of the slots whose
circular shift by k gives coordinate k.  A shingle's coordinates are therefore
one contiguous window of the second permutation.

With BANDS bands of ROWS coordinates, two sets of similarity s share no band
with probability (1 - s**ROWS)**BANDS: below 5e-8 at 0.8.  Pairs that share a
band are candidates; every link is confirmed on the full sets of 64-bit shingle
hashes.  All pairs of a bucket are never emitted: rows of equal sets (by size and
a 128-bit digest of all their hashes in order) are one class; a bucket's classes
are first compared with one pivot, then with the best-linked one; only classes
that are then still in different components are compared with each other, in
blocks of bounded size inside a task, and one link for each two components comes
out.  Sizes and signatures are compared before any set is sent, and a pivot's
set is sent once to each chunk of the classes that it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import BROADCAST_ROWS, arrow_map, free_name, materialize, text_or_empty, weighted_lookup
from normgraph.operators.components import connected_components
from normgraph.storage import settled

SLOTS = 1 << 20
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Members of a bucket that are compared with each other in one block.
BLOCK = 512
#: Classes that meet a pivot's set in one chunk.
CHUNK = 512
#: Standard deviations below the threshold at which a signature's estimate
#: rules a pair out (a miss of about 1 in 10 million at the threshold itself).
SIGMAS = 5.2
MEMO = 200_000

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text.

    Words are runs without ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z, which is
    what bytes.lower() and bytes.split() do.  A text of fewer words is one
    shingle; one without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    k = min(width, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix((out ^ h[j : n - k + 1 + j]) * M1 + np.uint64(j))
    return np.unique(out)


def second_permutation() -> np.ndarray:
    """Row i holds coordinates 0..COORDINATES-1 of slot i (a view, not a copy)."""
    pi = np.random.RandomState(20_011).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set."""
    slots = np.unique((mix(shingles) >> np.uint64(44)).astype(np.int64))
    low = None
    for at in range(0, len(slots), 4096):
        part = windows[slots[at : at + 4096]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix((out ^ rows[:, j]) * M1 + np.uint64(j))
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str, mark: str) -> DataFrame:
    """(id, n, f1, f2, sig, bands, mark) of every row; those from f1 to bands null for an empty set.

    f1 and f2 are a 128-bit digest of the set's hashes in order, sig a byte of
    each coordinate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, windows = WordHashes(), second_permutation()
        for batch in batches:
            n, f1, f2, sigs, bands = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_hashes(text.as_py() or b"", width, memo)
                n.append(len(s))
                if len(s):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s), dtype=np.int64)
                    f1.append(int(digest[0]))
                    f2.append(int(digest[1]))
                    sig = signature(s, windows)
                    sigs.append(sig.astype(np.uint8).tobytes())
                    bands.append(band_keys(sig))
                else:
                    for x in (f1, f2, sigs, bands):
                        x.append(None)
            ends = np.cumsum([0, *(0 if b is None else BANDS for b in bands)]).astype(np.int32)
            flat = [b for b in bands if b is not None]
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([b is None for b in bands], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary()), lists, batch.column(2)], names=["id", "n", "f1", "f2", "sig", "bands", "mark"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(mark).alias("mark"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n long, f1 long, f2 long, sig binary, bands array<long>, mark long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set array<long>) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_hashes(x.as_py() or b"", width, memo).view(np.int64) for x in part.column(1).cast(pa.binary())]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "set"])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, set array<long>")


def least_agreement(num: int, den: int) -> float:
    """Equal signature bytes that a pair at the threshold has but for SIGMAS deviations."""
    s = num / den
    return COORDINATES * (s - SIGMAS * math.sqrt(s * (1 - s) / COORDINATES))


def likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The (pivot, rep) that set sizes and signatures don't rule out.

    An id that stands for several classes is kept if any two of them fit.
    """
    facts = classes.select("rep", "n", "sig")
    both = pairs.join(facts.withColumnsRenamed({"rep": "pivot", "n": "na", "sig": "sa"}), "pivot").join(facts.withColumnsRenamed({"n": "nb", "sig": "sb"}), "rep")
    both = both.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("pivot", "rep", "sa", "sb")
    least = least_agreement(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in batch.columns[2:])
                good = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["pivot", "rep"])

    return arrow_map(both, run, "pivot long, rep long").distinct()


def sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, set) of the ids, a row for each distinct set; ``docs`` has id and text."""
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    hashed = shingle_sets(texts, width).withColumn("mark", F.xxhash64("set"))
    return materialize(hashed.dropDuplicates(["id", "mark"]).drop("mark"), "minhash-sets")


def grouped_map(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], of_group: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``of_group`` applied to each group of integer ``keys``, the first columns of ``df``, in the order of ``order``; groups are of bounded size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy() for k in range(len(keys))]
            cuts = np.flatnonzero(np.any([np.diff(v) != 0 for v in values], axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                here = tuple(int(v[s]) for v in values)
                if here != group:
                    found = of_group(rows) if rows else None
                    if found is not None:
                        yield found
                    group, rows = here, []
                rows.append(batch.slice(s, e - s))
        found = of_group(rows) if rows else None
        if found is not None:
            yield found

    return arrow_map(ordered, run, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The (a, b) whose full sets reach the threshold; ``docs`` has id and text.

    ``pairs`` has few distinct ``pivot`` ends with possibly very many others
    (``rep``).  These are dealt to chunks, and the pivot's set goes once to each.
    """
    pairs = pairs.select(F.col("pivot").cast("long").alias("pivot"), F.col("rep").cast("long").alias("rep"))
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    counts = materialize(counts, "pivot-chunks")
    sets = sets_of(materialize(pairs.select(F.col("pivot").alias("id")).union(pairs.select("rep")).distinct(), "minhash-ids"), docs, width)
    dealt = pairs.join(counts, "pivot").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    others = dealt.select("pivot", "chunk", "rep").join(sets.withColumnRenamed("id", "rep"), "rep").select("pivot", "chunk", F.lit(1).alias("side"), "rep", "set")
    heads = counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(sets.withColumnRenamed("id", "pivot"), "pivot").select("pivot", "chunk", F.lit(0).alias("side"), F.col("pivot").alias("rep"), "set")

    def meet(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        pivot, side, rep = (table.column(k).to_numpy() for k in (0, 2, 3))
        sets = [x.values.to_numpy() for x in table.column(4)]
        own = [x for x, s in zip(sets, side) if s == 0]
        linked = []
        for k in np.flatnonzero(side == 1):
            for x in own:
                shared = len(np.intersect1d(x, sets[k], assume_unique=True))
                if shared * den >= (len(x) + len(sets[k]) - shared) * num:
                    linked.append(k)
                    break
        if not linked:
            return None
        a, b = pivot[linked], rep[linked]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return grouped_map(heads.unionByName(others), ("pivot", "chunk"), ("side",), meet, "a long, b long").distinct()


def crossing_links(component: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows of ``first`` and ``second`` in different components, one pair for each two components.

    Intersection sizes of all pairs come from products of 0/1 matrices whose
    columns are the shingles that two or more rows have.
    """
    none = np.empty(0, np.int64)
    kinds, sizes = np.unique(component, return_counts=True)
    if len(kinds) < 2:
        return none, none
    # two rows of the commonest component need no look, so one is outside it
    common = kinds[sizes.argmax()]
    looks = [(first[component[first] != common], second)]
    if len(first) != len(second) or (first != second).any():
        looks.append((second[component[second] != common], first))
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, columns = 4096, int(column[-1]) + 1 if len(column) else 0
    shared = [np.zeros((len(x), len(y)), dtype=np.float32) for x, y in looks]
    for at in range(0, columns, width):
        s, e = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, columns - at)), dtype=np.float32)
        m[owner[s:e], column[s:e] - at] = 1
        for total, (x, y) in zip(shared, looks):
            if len(x):
                total += m[x] @ m[y].T
    xs, ys = [none], [none]
    for total, (x, y) in zip(shared, looks):
        linked = (total * den >= (n[x, None] + n[None, y] - total) * num) & (component[x, None] != component[None, y])
        i, j = np.nonzero(linked)
        xs.append(x[i])
        ys.append(y[j])
    x, y = np.concatenate(xs), np.concatenate(ys)
    pair = np.stack([np.minimum(component[x], component[y]), np.maximum(component[x], component[y])], axis=1)
    once = np.unique(pair, axis=0, return_index=True)[1] if len(x) else none
    return x[once], y[once]


def likely_members(component: np.ndarray, n: np.ndarray, sig: np.ndarray, first: np.ndarray, second: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places of the rows that sizes and signatures leave a possible partner in another component of the other side."""
    least, keep = least_agreement(num, den), np.zeros(len(n), bool)
    for at in range(0, len(first), 64):
        x = first[at : at + 64]
        pair = (component[x, None] != component[None, second]) & (np.minimum(n[x, None], n[None, second]) * den >= np.maximum(n[x, None], n[None, second]) * num)
        i, j = np.nonzero(pair)
        for s in range(0, len(i), 16_384):
            p, q = x[i[s : s + 16_384]], second[j[s : s + 16_384]]
            good = (sig[p] == sig[q]).sum(axis=1) >= least
            keep[p[good]] = keep[q[good]] = True
    return np.flatnonzero(keep)


def within_buckets(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among ``members`` (bucket, rep, component) of one bucket that join different components.

    Every pair of a bucket's rows in different components is decided, but inside
    a task: one link for each two components comes out of a group.  A bucket of
    more than BLOCK members is cut into blocks; each pair of blocks meets in one
    group of at most about 2 * BLOCK rows.  Groups are first made of sizes and
    signatures; only rows that these leave a possible partner get their sets.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    facts = dealt.join(classes.select("rep", "n", "sig"), "rep")
    spread = facts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "component", "n", "sig")
    keys = ("bucket", "lo", "hi")

    def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, mine = (table.column(k).to_numpy() for k in (1, 2, 3))
        first = np.flatnonzero(mine == lo[0])
        return first, first if lo[0] == hi[0] else np.flatnonzero(mine == hi[0])

    def hopeful(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        component, n = (table.column(k).to_numpy() for k in (5, 6))
        sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        keep = likely_members(component, n, sig, *sides(table), num, den)
        return table.select(range(6)).take(pa.array(keep)).combine_chunks().to_batches()[0] if len(keep) else None

    shape = "bucket long, lo int, hi int, mine int, rep long, component long"
    open_rows = materialize(grouped_map(cells, keys, (), hopeful, shape), "open-cells")
    sets = sets_of(materialize(open_rows.select(F.col("rep").alias("id")).distinct(), "minhash-ids"), docs, width)
    # sets come last: they are shuffled once with their rows
    whole = open_rows.join(sets.withColumnRenamed("id", "rep"), "rep").select(*keys, "mine", "rep", "component", "set")

    def decide(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        rep, component = (table.column(k).to_numpy() for k in (4, 5))
        x, y = crossing_links(component, [v.values.to_numpy() for v in table.column(6)], *sides(table), num, den)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], names=["a", "b"]) if len(x) else None

    return grouped_map(whole, keys, (), decide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_mark.

    Rows are linked when num / den of their shingle sets' union is shared;
    component_id is the smallest id reachable.  A null or empty text, or one of
    white space only, has no shingles and no links; a text of fewer than
    ``width`` words is one shingle.  Rows of one id count as one document, with
    the links of all its texts.  A null id takes its class's component, and null
    where the class has no other id; it is kept in the latter case only.
    text_mark is a hash of the row's text, which tells rows of one id (or none)
    apart.  Ids are integers; extra columns are ignored; an empty table gives an
    empty result.
    """
    mark = free_name(docs, "_mark")
    facts = materialize(sketches(docs.withColumn(mark, F.xxhash64(text_or_empty(text_col))), width, id_col, text_col, mark), "sketches")
    total = facts.count()
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = settled(spark, "class-components", lambda: class_components(facts, texts, width, num, den))
    out = weighted_lookup(facts.where("f1 IS NOT NULL").select("id", "n", "f1", "f2", "mark"), named, ["n", "f1", "f2"], "copies", total)
    out = out.select("id", "n", "component", "mark").unionByName(facts.where("f1 IS NULL").select("id", "n", F.col("id").cast("long").alias("component"), "mark"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").cast("long").eqNullSafe(F.col("component")).alias("kept"), F.col("mark").alias("text_mark"))


def class_components(facts: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(n, f1, f2, copies, component) of every class of equal non-empty sets."""
    classes = facts.where("f1 IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    listed = classes.where("rep IS NOT NULL").select("rep", F.explode("bands").alias("bucket"))
    buckets = listed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("pivot < last").select("bucket", "pivot", "size")
    buckets = materialize(buckets, "buckets")
    # a bucket may hold a third of all classes
    shared = weighted_lookup(listed, buckets, ["bucket"], "size", classes.count() * BANDS).select("bucket", "rep", "pivot")
    shared = materialize(shared, "bucket-members")

    tested = shared.where("rep <> pivot").select("pivot", "rep").distinct()
    tested = materialize(likely(tested, classes, num, den), "tested")
    links = materialize(confirmed(tested, texts, width, num, den), "links")
    found = connected_components(links, "a", "b")

    def open_buckets() -> DataFrame:
        """Rows of the buckets that hold more than one component."""
        rows = shared.join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return materialize(rows.join(mixed, "bucket", "left_semi"), "open-buckets")

    rest = open_buckets()
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("d"))
    ranked = rest.join(degree, "rep", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    pivots = materialize(ranked.groupBy("bucket").agg(F.max(F.struct("d", "rep")).alias("best")).select("bucket", F.col("best.rep").alias("pivot")), "pivots")
    crossing = rest.join(pivots, "bucket").join(found.withColumnsRenamed({"node": "pivot", "component": "pc"}), "pivot", "left").where(F.col("component") != F.coalesce("pc", "pivot"))
    second = crossing.select("pivot", "rep").distinct().join(tested, ["pivot", "rep"], "left_anti")
    second = materialize(likely(second, classes, num, den), "tested")
    if not second.isEmpty():
        more = materialize(confirmed(second, texts, width, num, den), "links")
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
        rest = open_buckets()

    # What is still open is decided inside tasks, on the full sets.
    more = materialize(within_buckets(rest, classes, texts, width, num, den), "links")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    return classes.select("n", "f1", "f2", "rep", "copies").join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select("n", "f1", "f2", "copies", F.coalesce("component", "rep").alias("component"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4).drop("text_mark")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n
"""
