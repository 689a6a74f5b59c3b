"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths (one count for each of 1..capacity) reaches
the driver.  For each bin pattern a bitset subset-sum over the lengths still
available finds the fullest combination with the longest remaining piece; the
pattern is used as often as the counts allow, so every round uses up a length
or one of its multiplicities.  Pieces then look up the bin of their rank among
the pieces of the same length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map, give_back, materialize, slices

CAPACITY = 4096
EOS = 1
#: Bytes of texts whose chunks are told apart together, about.
PART_BYTES = 2_000_000
#: Words whose ids a worker remembers at most, or else those of its last part, and the longest one it does.
MEMO, MEMO_CHARS = 100_000, 48
#: Words that are Python objects at a time.
RUN = 10_000
#: Pieces of one length that are ranked in one task, about.
SHARD_ROWS = 500_000

PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of white-space-free chunks, each computed once.

    The tokenizer drops white space before its merges, so a text's ids are its
    chunks' ids in a row.  It also splits letters from punctuation and
    lower-cases, so a plain word with punctuation after it is looked up as the
    lower-cased word and the punctuation.  Words in use are remembered, in
    columns: as Python objects they would take four times the memory.  A
    special token's string in a text gives that token, as the tokenizer has it:
    such chunks, and texts with one that holds white space, go to it whole.
    """

    #: White space when texts are split, but ordinary characters for the tokenizer.
    SEPARATORS = "[\x1c-\x1f]"
    PUNCTUATION = ".,;:!?"
    #: Latin-1 letters: they have one lower-case letter each, whatever stands around them.
    LETTERS = "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+"

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        whole = [self.SEPARATORS, *(re.escape(t) for t in added if len(t.split()) != 1 or t.strip() != t)]
        self.apart, self.plain_words = "|".join(whole), not any(all(c.isalpha() or c in self.PUNCTUATION for c in t) for t in added)
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = str.maketrans({c: to_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xA1, 0x100)) if c.isalpha()})
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.uint32()))

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """Ids of lower-case Latin-1 letters or of punctuation, which the merges get as one word, or of another chunk."""
        if self.plain_words and (re.fullmatch(self.LETTERS, word) or not word.strip(self.PUNCTUATION)):
            return [t.id for t in self.model.tokenize(word.translate(self.spelling))] if word else []
        return self.direct(word)

    def remembered(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct ``words``; only those not in memory are looked up one by one."""
        found = pc.index_in(words, value_set=self.words)
        fresh = words.filter(found.is_null())
        ids, ends = array("I"), array("i", [0])
        for at in range(0, len(fresh), RUN):
            for word in fresh.slice(at, RUN).to_pylist():
                ids.extend(self.word(word))
                ends.append(len(ids))
        table = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(np.asarray(ends, "i4")), pa.array(np.asarray(ids, "u4")))])
        place = found.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.words) + np.arange(len(fresh))
        out = table.take(pa.array(place))
        new, new_ids = (pa.concat_arrays([self.words, fresh]), table) if len(table) <= MEMO else (words, out)
        short = pc.less_equal(pc.utf8_length(new), MEMO_CHARS)
        self.words, self.ids = new.filter(short), new_ids.filter(short)
        return out

    def chunks(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of distinct ``chunks``, each as a word and the punctuation after it."""
        if self.plain_words:
            plain = pc.match_substring_regex(chunks, f"^{self.LETTERS}[{self.PUNCTUATION}]*$")
            word = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(chunks, self.PUNCTUATION)), chunks)
            after = pc.if_else(plain, pc.replace_substring_regex(chunks, f"^{self.LETTERS}", ""), "")
        else:
            word, after = chunks, pa.array([""] * len(chunks), pa.string())
        coded = pa.concat_arrays([word, after]).dictionary_encode()
        place = coded.indices.to_numpy().reshape(2, -1).T.ravel()
        halves = self.remembered(coded.dictionary).take(pa.array(place))
        return pa.ListArray.from_arrays(pa.array(halves.offsets.to_numpy()[::2].copy()), halves.values)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and where each text's begin and end.

        Chunks are told apart and counted in columns: only distinct ones are
        looked up.
        """
        has = pc.match_substring_regex(texts, self.apart)
        odd = np.flatnonzero(has.to_numpy(zero_copy_only=False)).tolist()
        words = pc.utf8_split_whitespace(pc.if_else(has, "", texts) if odd else texts)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        del words  # as large as the texts
        taken = self.chunks(coded.dictionary).take(coded.indices)
        ids, at = taken.values.to_numpy(zero_copy_only=False), taken.offsets.to_numpy()[ends].astype(np.int64)
        for k in reversed(odd):
            own = np.asarray(self.direct(texts[k].as_py()), dtype="<u4")
            ids = np.concatenate([ids[: at[k]], own, ids[at[k] :]])
            at[k + 1 :] += len(own)
        return ids, at


@lru_cache(maxsize=1)
def word_ids(tokenizer_json: str) -> WordIds:
    """One memory for all tasks of a worker process."""
    ids_of = WordIds(tokenizer_json)
    give_back()  # parsing takes more than the tokenizer
    return ids_of


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids and ``eos``, cut at ``capacity``."""
    with open(tokenizer_path, encoding="utf-8") as f:  # read by the driver: executors need no such file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.asarray([eos], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(shared.value)
        for whole in batches:
            if not whole.num_rows:
                continue
            for part in slices(whole, PART_BYTES):
                yield cut_part(ids_of, part)

    def cut_part(ids_of: WordIds, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = ids_of.of(batch.column(1).fill_null(""))
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        keys, piece, start, length, crc = [], [], [], [], []
        for row, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            for k, at in enumerate(range(0, e - s + 1, capacity)):
                stop = min(at + capacity, e - s)
                value = zlib.crc32(data[4 * (s + at) : 4 * (s + stop)])
                if e - s + 1 <= at + capacity:
                    value = zlib.crc32(end, value)
                keys.append(row)
                piece.append(k)
                start.append(at)
                length.append(min(capacity, e - s + 1 - at))
                crc.append(value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["id", "piece", "start", "length", "ids_crc32"],
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, cut, PIECES.format(id=rows.schema["id"].dataType.simpleString()))


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """The combination of available lengths that fills most of ``space``: length -> copies.

    Bit s of a bitset says that the lengths so far can sum to s.  A length's
    copies are taken in powers of two; longer lengths come first, and the
    search ends as soon as the space can be filled.
    """
    reach, goal, everything = 1, 1 << space, (1 << (space + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, k = min(counts[length], space // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & everything
            left -= k
            k *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def bin_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: copies in each}) that use up ``histogram``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fullest({k: v for k, v in counts.items() if v}, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        bins = min(counts[k] // m for k, m in used.items())
        plan.append((bins, used))
        for k, m in used.items():
            counts[k] -= bins * m
            if not counts[k]:
                del counts[k]
    return plan


def _intervals(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Of each length, which ranks go to which bins and where in them."""
    rows, taken, bin0 = [], {}, 0
    for bins, used in plan:
        at = 0
        for length in sorted(used, reverse=True):
            copies = used[length]
            rows.append((length, taken.get(length, 0), bin0, copies, at))
            taken[length] = taken.get(length, 0) + bins * copies
            at += length * copies
        bin0 += bins
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 46) + a[:, 1], "rank": a[:, 1], "bin": a[:, 2], "copies": a[:, 3], "at": a[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with sequence_id and offset."""
    spark = pieces.sparkSession
    # 1..capacity rows at most, whatever the input
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan = _intervals(bin_plan(histogram, capacity))
    shards = max(16, -(-sum(histogram.values()) // SHARD_ROWS))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    # capacity * shards rows at most
    bases = dealt.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = Window.partitionBy("length", "_shard").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(place)).join(bases, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1)
    shared = spark.sparkContext.broadcast(plan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            length = batch.column(3).to_numpy(zero_copy_only=False)
            k = np.searchsorted(p["key"], (length << 46) + rank, side="right") - 1
            nth = rank - p["rank"][k]
            sequence = p["bin"][k] + nth // p["copies"][k]
            offset = p["at"][k] + (nth % p["copies"][k]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    rows = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("rank"))
    schema = PIECES.format(id=rows.schema["id"].dataType.simpleString()) + ", sequence_id long, offset long"
    return arrow_map(rows, assign, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds ``eos`` only.  Only documents
    of more than ``capacity`` ids are cut.  Repeated rows and null ids are
    packed row by row; extra columns are ignored; an empty table packs nothing.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, eos), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


SQL = None  # tokenization: tested against the tokenizer itself and the packing's invariants
