"""Importance resampling towards a target distribution.

Features are runs of one to ``n`` consecutive words, hashed to buckets by the
CRC-32 of their bytes.  Each task keeps a trie of the words it has met: a node
stands for a run, holds the CRC state after its bytes, from which its children
go on, and counts how often the run came.  Counts are merged by bucket, so a
task hands on as many rows as there are buckets at most.  From the totals of
the corpus and of the target each bucket gets a gain; documents are scored by
walking the same tries with the gains attached to their nodes, and the best of
scores with Gumbel noise are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map, materialize
from normgraph.llm.words import PART_BYTES, WORDS_SQL, word_parts
from normgraph.operators.ranking import global_rank

N, BUCKETS = 2, 10_000
SEED, MIN_WORDS, SHARE = 7, 20, 25
#: Nodes after which a task's trie is given up for a new one (its counts are kept by bucket).
MAX_NODES = 500_000


def _crc_table() -> np.ndarray:
    """What CRC-32 (reflected, polynomial 0xEDB88320) adds for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()
#: Bytes of a word up to which CRC states are taken on column by column; longer words go one by one.
CRC_COLUMNS = 64


class _Words:
    """Distinct words in order of arrival, with their bytes."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.data, self.offsets = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct ``words``, new ones added, and which of them each word is."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        found = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        found[new] = len(self.words) + np.arange(len(new))
        fresh = pa.concat_arrays([distinct.take(pa.array(new))])
        ends = np.frombuffer(fresh.buffers()[1], np.int32)[: len(new) + 1].astype(np.int64) if len(new) else np.zeros(1, np.int64)
        if len(new):
            self.data = np.concatenate([self.data, np.frombuffer(fresh.buffers()[2], np.uint8)[: ends[-1]]])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends[1:]])
            self.words = pa.concat_arrays([self.words, fresh])
        return found, coded.indices.to_numpy(zero_copy_only=False)

    def go_on(self, crc: np.ndarray, words: np.ndarray) -> np.ndarray:
        """CRC states after the bytes of ``words``."""
        at, size = self.offsets[words], self.offsets[words + 1] - self.offsets[words]
        out = crc.astype(np.uint32)
        for k in np.flatnonzero(size > CRC_COLUMNS).tolist():
            out[k] = zlib.crc32(self.data[at[k] : at[k] + size[k]].tobytes(), int(out[k]))
        on = np.flatnonzero((size > 0) & (size <= CRC_COLUMNS))
        state = ~out[on]
        for column in range(CRC_COLUMNS):
            state = CRC_TABLE[(state ^ self.data[at[on] + column]) & 255] ^ state >> np.uint32(8)
            more = size[on] > column + 1
            if not more.all():
                out[on[~more]] = ~state[~more]
                on, state = on[more], state[more]
            if not len(on):
                break
        return out


class _Level:
    """Nodes of one depth: how they are found, the CRC state after their bytes, and a count or gain each."""

    def __init__(self):
        #: Ordered, for finding nodes: parent << 32 | word, or the word at the top.
        self.keys, self.nodes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.crc, self.value = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of distinct, ordered ``keys``, and which of them are new (numbered on from the last)."""
        at = np.searchsorted(self.keys, keys)
        there = np.append(self.keys, -1)[at] == keys
        found = np.empty(len(keys), np.int64)
        found[there] = self.nodes[at[there]]
        new = np.flatnonzero(~there)
        found[new] = len(self.crc) + np.arange(len(new))
        self.keys, self.nodes = np.insert(self.keys, at[new], keys[new]), np.insert(self.nodes, at[new], found[new])
        return found, new

    def add(self, crc: np.ndarray, value: np.ndarray) -> None:
        self.crc, self.value = np.concatenate([self.crc, crc]), np.concatenate([self.value, value])


class WordTrie:
    """Runs of up to ``n`` words that a task has met.

    A node of depth k is found by its parent, of depth k - 1, and its last word.
    Texts are walked a depth at a time: each place's node of depth k is the
    child of the node before it, of depth k - 1, by the place's word.  With
    ``gains`` nodes hold their bucket's gain, without they count runs.
    """

    def __init__(self, n: int = N, buckets: int = BUCKETS, gains: np.ndarray | None = None, max_nodes: int = MAX_NODES):
        self.n, self.buckets, self.gains, self.max_nodes = n, buckets, gains, max_nodes
        self.totals = np.zeros(buckets, np.int64)
        self.carry: list[str] = []
        self.levels: list[_Level] = []
        self.clear()

    def clear(self) -> None:
        """Start anew, keeping what was counted."""
        if self.gains is None:
            for level in self.levels:
                np.add.at(self.totals, level.crc % self.buckets, level.value)
        self.levels, self.words = [_Level() for _ in range(self.n)], _Words()

    def _nodes(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """Nodes of a depth by distinct, ordered keys; new ones go on from their parent's CRC state."""
        level = self.levels[depth]
        found, new = level.find(keys)
        if len(new):
            words = keys[new] & 0xFFFFFFFF
            if depth:
                before = self.levels[depth - 1].crc[keys[new] >> 32].astype(np.uint32)
                state = ~before
                before = ~(CRC_TABLE[(state ^ np.uint32(32)) & 255] ^ state >> np.uint32(8))  # the space between
            else:
                before = np.zeros(len(new), np.uint32)
            crc = self.words.go_on(before, words).astype(np.int64)
            level.add(crc, self.gains[crc % self.buckets] if self.gains is not None else np.zeros(len(new), np.int64))
        return found

    def walk(self, texts: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, gain) of every run of ``texts``, in parts; runs are counted where there are no gains (all gains 0)."""
        for part in word_parts(texts, limit):
            if sum(len(level.crc) for level in self.levels) > self.max_nodes:
                self.clear()
            words, ends = part.words, part.offsets
            had = self.carry if part.again else []
            if had:  # a text that goes on: its last words begin runs
                words, ends = pa.concat_arrays([pa.array(had, pa.string()), words]), np.concatenate([[0], ends[1:] + len(had)])
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            distinct, which = self.words.numbers(words)
            numbers = distinct[which]
            places, nodes = np.arange(len(numbers)), None
            for depth, level in enumerate(self.levels):
                if depth:  # places that have one more word of the same text before them
                    on = np.flatnonzero(places + 1 < len(numbers))
                    on = on[row[places[on]] == row[places[on] + 1]]
                    places, keys = places[on] + 1, nodes[on] << 32 | numbers[places[on] + 1]
                    distinct, which = np.unique(keys, return_inverse=True)
                    found = self._nodes(depth, distinct)
                else:
                    order = np.argsort(distinct)
                    found = np.empty(len(distinct), np.int64)
                    found[order] = self._nodes(depth, distinct[order])
                nodes = found[which]
                new = places >= len(had)  # the others were met in the part before
                if self.gains is None:
                    level.value[found] += np.bincount(which[new], minlength=len(found))
                yield part.row + row[places[new]], level.value[nodes[new]] if self.gains is not None else np.zeros(int(new.sum()), np.int64)
            # the last words of the last text, should it go on
            self.carry = words[max(int(ends[-2]), len(words) - self.n + 1) :].to_pylist()


def bucket_totals(texts: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS, max_nodes: int = MAX_NODES, limit: int = PART_BYTES) -> DataFrame:
    """(bucket, n): how many runs fall into each bucket; a task hands on a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(n, buckets, max_nodes=max_nodes)
        for batch in batches:
            for _ in trie.walk(batch.column(0), limit):
                pass
        trie.clear()
        at = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(trie.totals[at])], names=["bucket", "n"])

    return arrow_map(texts.select(F.col(text_col).cast("string").alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the totals of both sides: 1000 times the logarithm of the ratio of their smoothed shares, rounded down."""

    def totals(df: DataFrame) -> list[int]:
        found = [0] * buckets
        for r in df.collect():  # as many rows as there are buckets at most
            found[r.bucket] = r.n
        return found

    s, t = totals(corpus), totals(target)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(seed: int, doc_id: str | None) -> int:
    """Gumbel noise of a document, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N, seed: int = SEED, max_nodes: int = MAX_NODES, limit: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_features, weight, score), one row per document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(n, len(gains), gains, max_nodes)
        for batch in batches:
            n_words, n_runs, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, (row, gain) in enumerate(trie.walk(batch.column(1), limit)):
                runs = np.bincount(row, minlength=batch.num_rows)
                n_runs += runs
                if k % n == 0:  # runs of one word
                    n_words += runs
                total += np.bincount(row, weights=gain, minlength=batch.num_rows).astype(np.int64)  # whole numbers far below 2**53
            weight = np.where(n_runs > 0, total // np.maximum(n_runs, 1), 0)
            score = weight + np.array([noise(seed, x) for x in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_runs), pa.array(weight), pa.array(score)], names=["id", "n_words", "n_features", "weight", "score"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's id, n_features, weight, score and rank (null if it isn't drawn).

    Of the documents with at least ``min_words`` words ``share`` percent (rounded
    down) are drawn: the highest scores, ties to the smaller id (null first),
    then to fewer features.  A document's weight is the mean gain of its runs,
    rounded down, 0 without any; its score adds noise that depends on ``seed``
    and its id alone, so rows of one id have the same.  A null text has no
    words; an empty table gives an empty result; with an empty target all
    weights come from the corpus alone.  Extra columns are ignored.
    """
    gains = bucket_gains(bucket_totals(docs, text_col, n, buckets), bucket_totals(target, target_col, n, buckets), buckets)
    found = materialize(scored(docs, gains, id_col, text_col, n, seed), "scored-documents")
    able = F.col("n_words") >= min_words
    drawn = found.where(able).count() * share // 100
    order = found.where(able).withColumn("_tie", F.struct(id_col, "n_features"))
    ranked = global_rank(order, F.col("score"), "rank", "_tie").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(found.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ids are taken to be unique."""
    drawn = resample(docs, target, id_col, **options).where(F.col("rank").isNotNull()).select(F.col(id_col).alias("_drawn"))
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, benchmark)


SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
r AS (
  SELECT rid, w[i] AS run FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)
  UNION ALL SELECT rid, w[i] || ' ' || w[i + 1] FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1)
), q AS (
  SELECT w[i] AS run FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM b WHERE len(w) > 0)
  UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM b WHERE len(w) > 1)
), f AS (
  SELECT run, hex(encode(run)) AS x FROM (SELECT run FROM r UNION SELECT run FROM q)
), k AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM f, tab
), s AS (SELECT bucket, count(*) AS n FROM r JOIN k USING (run) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM q JOIN k USING (run) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}) AS DOUBLE) / CAST((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM r JOIN k USING (run) JOIN g USING (bucket) GROUP BY rid),
z AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN m USING (rid)
), e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
o AS (
  SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS place FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * (SELECT count(*) FROM e WHERE n_words >= {MIN_WORDS}) // 100 THEN place END AS rank FROM o
"""
