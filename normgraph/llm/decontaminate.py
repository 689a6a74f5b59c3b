"""Benchmark decontamination with suffix arrays of the training texts.

Every batch of documents is a shard.  Its words become numbers in the
benchmark's vocabulary (0 for every other word and between documents), and its
suffixes are sorted into a suffix array.  Suffixes whose first words begin no
test suffix can't match one and are left out of it, which changes no result.
Every test suffix is then sought by binary search: the range of its first
``window`` words holds all places where that passage stands; going on inside
the range, block of words by block of words, the neighbours of the place where
a test suffix would stand share its longest verbatim match.  Documents with a
match are marked or removed where they lie: nothing is shuffled but one row for
each test suffix and shard where locations are asked for.

The benchmark is taken in groups of at most GROUP_WORDS words, each of which is
broadcast; with more than one group, the spans of each are united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map, materialize, text_or_empty
from normgraph.llm.words import PART_BYTES, WORDS_SQL, word_parts

WINDOW = 10
#: Words of the benchmark that are broadcast together, about.
GROUP_WORDS = 2_000_000


def blocks(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` words from each place on, up to the first 0, as rows; ``ids`` ends with ``size`` zeros at least."""
    found = ids[np.minimum(at[:, None] + np.arange(size), len(ids) - 1)]
    return found * np.logical_and.accumulate(found != 0, axis=1)


def keys_of(rows: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Rows of numbers as byte strings of the same order; ``after`` comes first."""
    if after is not None:
        rows = np.concatenate([after[:, None], rows], axis=1)
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class TestSuffixes:
    """Suffixes of the items of one group, their windows and their vocabulary."""

    __test__ = False  # no test class

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.heads_of = [b" ".join(words[:window]).decode() for _, words in items]
        self.vocabulary = sorted({w for _, words in items for w in words})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        ids, starts, owner, place = [], [], [], []
        size = 0
        for k, (_, words) in enumerate(items):
            ids += [number[w] for w in words] + [0]
            for s in range(max(1, len(words) - window + 1) if words else 0):
                starts.append(size + s)
                owner.append(k)
                place.append(s)
            size += len(words) + 1
        self.ids = np.array(ids + [0] * window, np.uint32)
        self.starts, self.owner, self.place = np.array(starts, np.int64), np.array(owner, np.int64), np.array(place, np.int64)
        self.longest = max((len(words) for _, words in items), default=0)
        rows = blocks(self.ids, self.starts, window)
        # a window each, whatever number of suffixes begin with it
        self.keys, first, self.of = np.unique(keys_of(rows), return_index=True, return_inverse=True)
        self.sizes = np.count_nonzero(rows[first], axis=1)
        # what follows a short item's words doesn't matter
        tops = np.where(rows[first] != 0, rows[first], np.uint32(0xFFFFFFFF))
        self.tops = keys_of(tops)
        by = np.lexsort((self.owner, self.of))
        self.owners = np.split(self.owner[by], np.flatnonzero(np.diff(self.of[by])) + 1) if len(by) else []
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        self.pairs = [np.unique(rows[:, j].astype(np.int64) << 32 | rows[:, j + 1]) for j in range(0, self.least - 1, 2)]
        self.heads = np.zeros(len(self.vocabulary) + 1, bool)
        if len(rows):
            self.heads[rows[:, 0]] = True
        self._value_set: pa.Array | None = None

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Words as numbers of the vocabulary, 0 for others."""
        if self._value_set is None:
            self._value_set = pa.array(self.vocabulary, pa.binary()).cast(pa.string())
        return (pc.index_in(words, value_set=self._value_set).fill_null(-1).to_numpy(zero_copy_only=False) + 1).astype(np.uint32)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_value_set": None}


@dataclass
class Shard:
    """A suffix array over numbered words.

    ``ids`` holds the words of several documents with a 0 after each.
    """

    ids: np.ndarray
    tests: TestSuffixes
    places: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        tests, ids = self.tests, self.ids
        at = np.flatnonzero(tests.heads[ids])
        for j, known in enumerate(tests.pairs):
            pair = ids[at + 2 * j].astype(np.int64) << 32 | ids[np.minimum(at + 2 * j + 1, len(ids) - 1)]
            at = at[known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair]
        keys = keys_of(blocks(ids, at, tests.window))
        order = np.argsort(keys, kind="stable")
        self.places, self.keys = at[order], keys[order]

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the part of the suffix array that begins with it."""
        return np.searchsorted(self.keys, self.tests.keys, "left"), np.searchsorted(self.keys, self.tests.tops, "right")

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of a window."""
        low, high = self.ranges()
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        return which, self.places[np.repeat(low, size) + inside]

    def longest(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, length, place) of each test suffix whose window stands here.

        Of equally long matches the one of the smallest ``rank`` of its place.
        """
        tests, width = self.tests, self.tests.window
        which, places = self.spans()
        suffixes = np.flatnonzero(np.isin(tests.of, which))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group, own, depth = which, tests.of[suffixes], tests.sizes[tests.of[suffixes]]
        for level in range(1, tests.longest // width + 2):
            if not len(suffixes):
                break
            train = blocks(self.ids, places + level * width, width)
            train[tests.sizes[which] < width] = 0  # a short item ends there
            keys = keys_of(train, group.astype(np.uint32))
            order = np.argsort(keys, kind="stable")
            keys, train, places, which, group = keys[order], train[order], places[order], which[order], group[order]
            test = blocks(tests.ids, tests.starts[suffixes] + level * width, width)
            test[depth < level * width] = 0
            sought = keys_of(test, own.astype(np.uint32))
            low, high = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
            on = (high > low) & (test[:, -1] != 0)
            # the longest match with a neighbour of the same group
            best = np.zeros(len(suffixes), np.int64)
            for near in (low - 1, low):
                there = np.clip(near, 0, len(keys) - 1)
                same = (near >= 0) & (near < len(keys)) & (group[there] == own)
                common = np.logical_and.accumulate((train[there] == test) & (test != 0), axis=1).sum(axis=1)
                best = np.maximum(best, np.where(same, common, 0))
            # all places that share it stand together
            shared = np.where(np.arange(width) < best[:, None], test, 0)
            above = np.where(np.arange(width) < best[:, None], test, np.uint32(0xFFFFFFFF))
            first = np.searchsorted(keys, keys_of(shared, own.astype(np.uint32)), "left")
            last = np.searchsorted(keys, keys_of(above, own.astype(np.uint32)), "right")
            ranked = np.append(rank[places], np.iinfo(np.int64).max)
            least = np.minimum.reduceat(ranked, np.stack([first, last], axis=1).ravel())[::2]
            out.append((suffixes[~on], depth[~on] + best[~on], least[~on]))
            # those whose whole block is there go on among the places that share it
            _, number = np.unique(np.concatenate([keys, sought]), return_inverse=True)
            group, own = number[: len(keys)], number[len(keys) :][on]
            suffixes, depth = suffixes[on], depth[on] + width
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


@dataclass(frozen=True)
class Segment:
    """Documents of a shard: numbered words with a 0 after each, and for each document its row, where its own words stand, and the number of its words before."""

    ids: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray


def segments(texts: pa.Array, tests: TestSuffixes, limit: int = PART_BYTES) -> Iterator[Segment]:
    """``texts`` in shards; one that is longer than a part comes in pieces that overlap by the longest match."""
    long: list[np.ndarray] = []
    parts = word_parts(texts, limit)
    part = next(parts, None)
    while part is not None:
        follow = next(parts, None)
        found = tests.numbers(part.words)
        if part.again or (follow is not None and follow.again):
            long.append(found)
            if follow is None or not follow.again:
                yield from _pieces(np.concatenate(long), part.row, max(tests.window, tests.longest), limit // 4)
                long = []
        else:
            n = len(part.offsets) - 1
            ids = np.insert(found, part.offsets[1:], 0)
            walls = np.arange(n)
            yield Segment(np.append(ids, np.zeros(tests.window, np.uint32)), part.row + walls, part.offsets[:-1] + walls, part.offsets[1:] + walls, np.zeros(n, np.int64))
        part = follow


def _pieces(ids: np.ndarray, row: int, margin: int, size: int) -> Iterator[Segment]:
    for at in range(0, len(ids), size):
        low, stop = max(0, at - margin), min(len(ids), at + size)
        piece = np.append(ids[low : stop + margin], np.zeros(margin, np.uint32))
        yield Segment(piece, np.array([row]), np.array([at - low]), np.array([stop - low]), np.array([at]))


def _hits(texts: pa.Array, tests: TestSuffixes, limit: int) -> tuple[np.ndarray, dict[int, tuple[list[np.ndarray], set[int]]]]:
    """Words of each row and, of rows with a hit, the places of hit words and the items."""
    n_words, found = np.zeros(len(texts), np.int64), {}
    for seg in segments(texts, tests, limit):
        n_words[seg.rows] += seg.ends - seg.starts
        if not len(tests.keys):
            continue
        which, places = Shard(seg.ids, tests).spans()
        if not len(which):
            continue
        change = np.zeros(len(seg.ids) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + tests.sizes[which], -1)
        hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        doc = np.searchsorted(seg.starts, hit, "right") - 1
        own = (doc >= 0) & (hit < seg.ends[doc])
        hit, doc = hit[own], doc[own]
        for d, words in zip(*_grouped(doc, hit)):
            found.setdefault(int(seg.rows[d]), ([], set()))[0].append(words - seg.starts[d] + seg.before[d])
        # an occurrence belongs to the piece that has its first word
        doc = np.searchsorted(seg.starts, places, "right") - 1
        own = (doc >= 0) & (places < seg.ends[doc])
        for d, windows in zip(*_grouped(doc[own], which[own])):
            items = found.setdefault(int(seg.rows[d]), ([], set()))[1]
            for w in np.unique(windows).tolist():
                items.update(tests.owners[w].tolist())
    return n_words, found


def _grouped(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(key):
        return [], []
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate([[0], cuts])].tolist(), np.split(value, cuts)


def _items_digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_groups(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS) -> Iterator[TestSuffixes]:
    """Items in groups of about ``group_words`` words at most, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, list[str]] = {}
            for part in word_parts(batch.column(1)):
                for k in range(len(part.offsets) - 1):
                    texts.setdefault(part.row + k, []).extend(part.words[part.offsets[k] : part.offsets[k + 1]].to_pylist())
            words = [texts.get(k, []) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int64())], names=["item", "words", "n"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    found = materialize(arrow_map(rows, run, "item string, words string, n long").where("n > 0").distinct(), "benchmark-words")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-total * 2 // group_words)) if total > group_words else 1
    for k in range(groups):
        part = found if groups == 1 else found.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == k)
        yield TestSuffixes([(r.item, r.words.encode().split(b" ")) for r in part.orderBy("item", "words").collect()], window)


test_groups.__test__ = False

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS, limit: int = PART_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all of a shorter
    item that has words; a document's word inside any occurrence of one is hit.
    n_items counts the items with a window that occurs, items_sha256 is the
    digest of their ids, sorted as strings and joined by commas.  A null text
    has no words; an item without an id has the id ''; rows of one id are one
    item of several texts; repeated documents get a row each; without documents
    the result is empty, without items nothing is hit.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    groups = [spark.sparkContext.broadcast(g) for g in test_groups(benchmark, item_col, item_text_col, window, group_words)]
    if len(groups) == 1:
        shared = groups[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                n_words, found = _hits(batch.column(1), tests, limit)
                n_hit, n_items, digest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [_items_digest(set())] * batch.num_rows
                for k, (words, items) in found.items():
                    names = {tests.names[x] for x in items}
                    n_hit[k], n_items[k], digest[k] = sum(map(len, words)), len(names), _items_digest(names)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0)], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return arrow_map(rows, run, f"id {kind}, {REPORT}").withColumnRenamed("id", id_col)
    return _united(rows, groups, limit).withColumnRenamed("id", id_col)


def _united(rows: DataFrame, groups: list, limit: int) -> DataFrame:
    """``contamination`` where the benchmark comes in several groups: spans and items of each, united by document."""
    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.select("id", "text", F.xxhash64(text_or_empty("text")).alias("mark"))
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def spans_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                _, found = _hits(batch.column(1), tests, limit)
                at = sorted(k for k in found if found[k][0])
                spans = []
                for k in at:
                    words = np.unique(np.concatenate(found[k][0]))
                    cut = np.flatnonzero(np.diff(words) > 1) + 1
                    spans.append([{"s": s, "e": e + 1} for s, e in zip(words[np.concatenate([[0], cut])].tolist(), words[np.append(cut, len(words)) - 1].tolist())])
                names = [sorted({tests.names[x] for x in found[k][1]}) for k in at]
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(2).take(place), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))], names=["id", "mark", "spans", "items"])

        return run

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                upto = total = 0
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    total += max(0, e - max(s, upto))
                    upto = max(upto, e)
                out.append((total, len(items), _items_digest(set(items))))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], names=["_id", "_mark", "n_hit", "n_items", "items_sha256"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for part in word_parts(batch.column(1), limit):
                n[part.row : part.row + len(part.offsets) - 1] += np.diff(part.offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], names=["id", "mark", "n_words"])

    every = None
    for shared in groups:
        part = arrow_map(marked, spans_of(shared), f"id {kind}, mark long, spans array<struct<s:long,e:long>>, items array<string>")
        every = part if every is None else every.unionByName(part)
    # rows of one id and text have the same spans, so a set of them will do
    joined = every.groupBy("id", "mark").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = arrow_map(joined, unite, f"_id {kind}, _mark long, n_hit long, n_items long, items_sha256 string")
    base = arrow_map(marked, counted, f"id {kind}, mark long, n_words long")
    both = base.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return both.select("id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(_items_digest(set()))).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS, limit: int = PART_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns stay, null texts too."""
    for group in test_groups(benchmark, item_col, item_text_col, window, group_words):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(group), docs.columns.index(text_col), limit)
    return docs


def _without(docs: DataFrame, shared, column: int, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[list(_hits(batch.column(column).cast(pa.string()), shared.value, limit)[1])] = False
            yield batch.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS, limit: int = PART_BYTES) -> DataFrame:
    """(item_id string, item_words string, item_start, length, doc_id, doc_start): the longest verbatim match of each test suffix that has one.

    A test suffix is what follows a place of an item; matches have ``window``
    words at least, or all of a shorter item.  Of equally long ones the first
    stays: of the smallest document (null last), there of the smallest place.
    Places and lengths are words.  item_words, an item's first words, tells
    items of one id apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def matches(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                order = pc.sort_indices(batch.column(0)).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                for seg in segments(batch.column(1), tests, limit) if len(tests.keys) else ():
                    at = np.arange(len(seg.ids))
                    doc = np.clip(np.searchsorted(seg.starts, at, "right") - 1, 0, None)
                    place = rank[seg.rows[doc]] << 32 | (at - seg.starts[doc] + seg.before[doc])
                    suffix, length, best = Shard(seg.ids, tests).longest(place)
                    if len(suffix):
                        owner = tests.owner[suffix]
                        yield pa.RecordBatch.from_arrays([pa.array([tests.names[k] for k in owner], pa.string()), pa.array([tests.heads_of[k] for k in owner], pa.string()), pa.array(tests.place[suffix]), pa.array(length), batch.column(0).take(pa.array(order[best >> 32])), pa.array(best & 0xFFFFFFFF)], names=["item_id", "item_words", "item_start", "length", "doc", "doc_start"])

        return run

    every = None
    for group in test_groups(benchmark, item_col, item_text_col, window, group_words):
        part = arrow_map(rows, matches(spark.sparkContext.broadcast(group)), f"item_id string, item_words string, item_start long, length long, doc {kind}, doc_start long")
        every = part if every is None else every.unionByName(part)
    best = F.min(F.struct((-F.col("length")).alias("length"), F.col("doc").isNull().alias("none"), "doc", "doc_start"))
    found = every.groupBy("item_id", "item_words", "item_start").agg(best.alias("x"))
    return found.select("item_id", "item_words", "item_start", (-F.col("x.length")).alias("length"), F.col("x.doc").alias(id_col if id_col != "item_id" else "doc_id"), F.col("x.doc_start").alias("doc_start"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
t AS (
  SELECT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)
), x AS (SELECT DISTINCT k, words FROM t),
p AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
m AS (
  SELECT rid, i, k, x.words FROM (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS words FROM p, (SELECT DISTINCT k FROM x) WHERE i + k - 1 <= len(w)) o JOIN x USING (k, words)
), h AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(i, i + k - 1)) AS at FROM m) GROUP BY rid
), o AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m JOIN t USING (k, words)) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN o USING (rid)
"""
