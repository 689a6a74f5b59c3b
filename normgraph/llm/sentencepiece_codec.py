"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives a single-pass Viterbi: at each
position the automaton's output links list every piece that ends there, longest
first, and each relaxes the best score of that position.  Piece scores come from
the model file; a character that no piece holds alone falls back to its UTF-8
bytes.  No piece of the model is left out.  Texts are cut only where no piece
reaches over: around line ends and before a run of white space marks, which
stays together with the word after it.  Such chunks are encoded once and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map

SPACE = "▁"
#: Score below the worst piece that a byte fallback has for a character.
UNKNOWN_PENALTY = 10.0
MEMO, MEMO_CHARS = 200_000, 48


@lru_cache(maxsize=4)
def load_pieces(path: str) -> tuple[tuple[tuple[str, float, int], ...], tuple[int, ...], int]:
    """((piece, score, id), ...), the ids of the 256 bytes, and the number of ids; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, at_byte = [], [-1] * 256
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            at_byte[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((text, float(model.get_score(i)), i))
    if min(at_byte) < 0:
        raise ValueError("the model has no byte pieces to fall back to")
    return tuple(pieces), tuple(at_byte), model.get_piece_size()


class Codec(dict):
    """Encodes texts; remembers (ids, score) of words and empties itself when full."""

    PUNCTUATION = ".,;:!?"
    WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
    WHOLE = re.compile(".+", re.DOTALL)
    #: Inside a piece, a place where WORDS cuts.
    CROSSING = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.DOTALL)

    def __init__(self, pieces, at_byte, size):
        import ahocorasick

        super().__init__()
        self.at_byte = at_byte
        self.automaton = ahocorasick.Automaton()
        for text, score, i in pieces:
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        self.alone = frozenset(text for text, _, _ in pieces if len(text) == 1)
        self.joined = frozenset(text[k : k + 2] for text, _, _ in pieces for k in range(len(text) - 1))
        # a model with a piece that WORDS would cut has its texts searched as they are
        self.chunks = self.WHOLE if any(self.CROSSING.search(text) for text, _, _ in pieces) else self.WORDS
        self.words: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}
        self.unknown = min(score for _, score, _ in pieces) - UNKNOWN_PENALTY
        self.bytes_of = [b""] * size
        for text, _, i in pieces:
            self.bytes_of[i] = text.replace(SPACE, " ").encode()
        for b, i in enumerate(at_byte):
            self.bytes_of[i] = bytes([b])

    def search(self, text: str) -> tuple[list[int], float]:
        """The best segmentation of ``text``: piece ids and their score."""
        if not self.alone.issuperset(text):
            return self.search_with_bytes(text)
        best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):
            total = best[end + 1 - piece[0]] + piece[1]
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        ids, at = [], len(text)
        while at:
            piece = back[at]
            ids.append(piece[2])
            at -= piece[0]
        return ids[::-1], best[-1]

    def search_with_bytes(self, text: str) -> tuple[list[int], float]:
        """The same where some character is no piece of its own."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            ends[end].append(piece)
        for end, c in enumerate(text):
            for length, score, i in ends[end]:
                total = best[end + 1 - length] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (length, i)
            if c not in self.alone and best[end] + self.unknown > best[end + 1]:
                best[end + 1], back[end + 1] = best[end] + self.unknown, (1, -1)
        ids, at = [], n
        while at:
            length, i = back[at]
            ids.extend([i] if i >= 0 else [self.at_byte[b] for b in reversed(text[at - 1].encode())])
            at -= length
        return ids[::-1], best[n]

    def word(self, word: str) -> tuple[bytes, float]:
        found = self.words.get(word)
        if found is None:
            found = self.older.pop(word, None)
            if found is None:
                ids, score = self.search(word)
                found = np.asarray(ids, dtype="<i4").tobytes(), score
            if len(word) <= MEMO_CHARS:
                if len(self.words) >= MEMO:
                    self.words, self.older = {}, self.words  # words in use come back from there
                self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> tuple[bytes, float]:
        head = chunk.rstrip(self.PUNCTUATION)
        # no piece holds these two characters side by side: any segmentation is cut between them
        if head and len(head) < len(chunk) and chunk[len(head) - 1 : len(head) + 1] not in self.joined:
            (x, s), (y, t) = self.word(head), self.word(chunk[len(head) :])
            value = x + y, s + t
        else:
            value = self.word(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = value
        return value

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian ids and score.  A mark that stands in the text itself is written as bytes."""
        if not text:
            return b"", 0.0
        mark = np.asarray([self.at_byte[b] for b in SPACE.encode()], dtype="<i4").tobytes()
        out, score = [], 0.0
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(mark)
                score += self.unknown
            words = self.chunks.findall(("" if k else SPACE) + part.replace(" ", SPACE))
            found = list(map(self.__getitem__, words))
            out.extend(x for x, _ in found)
            score += sum(s for _, s in found)
        return b"".join(out), score

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(parts: tuple) -> Codec:
    """One codec, with one memory, for all tasks of a worker process."""
    return Codec(*parts)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int>, score double.

    A space becomes the model's mark and one mark is put before a text that
    isn't empty.  A null or empty text has no ids.  Of segmentations of one score
    the automaton's first stays, which is the same for every run.  Repeated rows
    get a row each; extra columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(shared.value)
            # a few texts at a time: ids need more room than text
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [codec.encode(t.as_py() or "") for t in part.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x, _ in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x for x, _ in got), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([s for _, s in got], pa.float64())], names=["id", "ids", "score"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, score double").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text, n_pieces, n_bytes, ids_crc32) of rows with ids.

    Null or empty ids give an empty text; bytes that are no UTF-8 give
    replacement characters.  Repeated rows get a row each; extra columns are
    ignored; an empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or codec_of(shared.value)
            is_byte = np.zeros(len(codec.bytes_of), dtype=bool)
            is_byte[list(codec.at_byte)] = True
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, n, fallen, crc = [], [], [], []
                for x in part.column(1):
                    ids = x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)
                    texts.append(codec.decode(ids.tolist()))
                    n.append(len(ids))
                    fallen.append(int(is_byte[ids].sum()))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in (n, fallen, crc))], names=["id", "text", "n_pieces", "n_bytes", "ids_crc32"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_pieces long, n_bytes long, ids_crc32 long").withColumnRenamed("id", id_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with a digest of what comes back."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
    back = decode(encoded, model_path())
    return back.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


SQL = None  # tested against a dynamic program over all pieces and by round trips
