"""Fill-in-the-middle examples by a parallel automaton scan.

Tokens begin where white space follows a word and at the text's start, so an
automaton over characters counts them: its states say whether the text has
begun and whether the last character belongs to a word, and how much of a mark
(``<P>``, ``<S>``, ``<M>``) has just been read.  A chunk of a text is scanned
without knowing in which state it is entered: it gives, for every entry state,
the state it is left in and how many tokens begin in it.  Such functions
compose associatively, so composing those of the chunks before it resolves each
chunk's entry state and its tokens' numbers.  That tells which chunk holds a
cut, and a scan of this one chunk finds the place.

Texts of up to one chunk are their own only chunk.  Chunks of longer ones are
dealt to tasks; their functions, of a fixed width, meet by document, and what
goes back to the chunks is two places a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import BROADCAST_ROWS, arrow_map, materialize, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Code points of a chunk.
CHUNK = 1 << 16

# States: 4 * place + mark.  place: 0 before the text, 1 in white space, 2 in a word.  mark: 0 nothing, 1 "<", 2 "<" and a letter, 3 a whole mark was read.
BEFORE, GAP, WORD = 0, 1, 2
STATES = 12
WHITE, LESS, LETTER, MORE, OTHER = range(5)
CLASSES = {**dict.fromkeys(b" \t\n\x0b\x0c\r", WHITE), ord("<"): LESS, **dict.fromkeys(b"PSM", LETTER), ord(">"): MORE}
CLASS_OF = np.array([CLASSES.get(c, OTHER) for c in range(256)], np.uint8)


def _next(state: int, kind: int) -> tuple[int, int]:
    """The state after a character of class ``kind``, and 1 if a token begins with it."""
    place, mark = divmod(state, 4)
    begins = int(place == BEFORE or (place == WORD and kind == WHITE))
    if mark < 3:
        mark = 1 if kind == LESS else 2 if mark == 1 and kind == LETTER else 3 if mark == 2 and kind == MORE else 0
    return 4 * (GAP if kind == WHITE else WORD) + mark, begins


NEXT, BEGINS = (np.array([[_next(s, k)[x] for k in range(5)] for s in range(STATES)], np.int64) for x in range(2))
#: Characters after which the state doesn't depend on the one before them, but for a whole mark.
MEMORY = 3
IDENTITY = (np.arange(STATES), np.zeros(STATES, np.int64))

Function = tuple[np.ndarray, np.ndarray]


def run_over(kinds: np.ndarray, states: np.ndarray) -> Function:
    """States and counts after ``kinds``, for each entry state."""
    count = np.zeros(len(states), np.int64)
    for k in kinds.tolist():
        count += BEGINS[states, k]
        states = NEXT[states, k]
    return states, count


def function_of(chunk: bytes) -> Function:
    """The chunk's transition function: for each entry state the exit state and the tokens that begin in it."""
    kinds = CLASS_OF[np.frombuffer(chunk, np.uint8)]
    every = np.arange(STATES)
    if len(kinds) <= 2 * MEMORY:
        return run_over(kinds, every)
    # the first characters show what the entry state changes; from there on all go the same way
    head, count = run_over(kinds[:MEMORY], every)
    white = kinds == WHITE
    count = count + int(np.count_nonzero(white[MEMORY:] & ~white[MEMORY - 1 : -1]))
    tail, _ = run_over(kinds[-MEMORY:], np.array([4 * GAP]))
    whole = (head % 4 == 3) | any(m.encode() in chunk for m in (PREFIX, SUFFIX, MIDDLE))
    exit_state = np.where(whole, tail[0] // 4 * 4 + 3, tail[0])
    return exit_state, count


def compose(first: Function, then: Function) -> Function:
    """``then`` after ``first``; associative, with IDENTITY as its neutral element."""
    return then[0][first[0]], first[1] + then[1][first[0]]


def place_of(chunk: bytes, entry: int, number: int) -> int:
    """The code point of ``chunk`` with which the token of that number (from 0, of those beginning in it) begins."""
    data = np.frombuffer(chunk, np.uint8)
    white = CLASS_OF[data] == WHITE
    begins = np.empty(len(data), bool)
    begins[1:] = white[1:] & ~white[:-1]
    begins[0] = bool(BEGINS[entry, CLASS_OF[data[0]]])
    at = int(np.flatnonzero(begins)[number])
    return int(np.count_nonzero((data[:at] & 0xC0) != 0x80))


def plan_of(functions: list[Function], draws: tuple[int, int, int, int], fim: int, spm: int) -> tuple[int, str, list[tuple[int, int, int] | None]]:
    """(tokens, form, the two cuts as (chunk, entry state, number in the chunk); None is the text's end) of a text by its chunks' functions."""
    state, upto, entries = 0, [0], []
    for leaves, counts in functions:
        entries.append(state)
        upto.append(upto[-1] + int(counts[state]))
        state = int(leaves[state])
    n = upto[-1]
    if not n or state % 4 == 3 or draws[2] % 100 >= fim:
        return n, "plain", []
    cuts = []
    for k in sorted(draw % (n + 1) for draw in draws[:2]):
        c = int(np.searchsorted(upto, k, "right")) - 1  # the chunk in which token k begins
        cuts.append(None if k == n else (c, entries[c], k - upto[c]))
    return n, "spm" if draws[3] % 100 < spm else "psm", cuts


def draws_of(seed: int, doc_id: str | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def rearranged(text: str, form: str, first: int | None, second: int | None) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: str, form: str) -> str:
    """The text that an output of that form was made of; no mark stands in its parts."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(two, len(one))
    end = output.index(MIDDLE, at + len(two))
    first, second, middle = output[len(one) : at], output[at + len(two) : end], output[end + len(MIDDLE) :]
    return first + middle + second if form == "psm" else second + middle + first


PLAN = "n long, form string, first long, second long"


def infill_plans(docs: DataFrame, id_col: str, text_col: str, seed: int, fim: int, spm: int, chunk: int) -> DataFrame:
    """(id, mark, n, form, first, second) of the texts of more than one chunk, one row for each id and text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                for c, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([c], pa.int32()), pa.array([text[at : at + chunk]], pa.string())], names=["id", "mark", "chunk", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function_of(x.as_py()) for x in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([f[x].tolist() for f in found], pa.list_(pa.int64())) for x in range(2))], names=["id", "mark", "chunk", "leaves", "counts"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, functions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n, form, cuts = plan_of([(np.array(f["leaves"]), np.array(f["counts"])) for f in functions], draws_of(seed, name), fim, spm)
                cuts = [{"which": w, "chunk": c[0], "entry": c[1], "number": c[2]} for w, c in enumerate(cuts) if c]
                out.append((n, form, cuts))
            columns = list(zip(*out)) if out else [()] * 3
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("which", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("number", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=["id", "mark", "n", "form", "cuts"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [c * chunk + place_of(text, entry, number) for c, text, entry, number in zip(batch.column(3).to_pylist(), batch.column(4).cast(pa.binary()).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64())], names=["id", "mark", "which", "place"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialize(arrow_map(rows, cut, f"id {kind}, mark long, chunk int, text string").repartition(parts, "id", "mark", "chunk"), "text-chunks")
    scanned = arrow_map(chunks, scan, f"id {kind}, mark long, chunk int, leaves array<long>, counts array<long>")
    # repeated rows have the same chunks: one of each is enough.  A text has as many chunks as the longest string a row can hold.
    one = scanned.groupBy("id", "mark", "chunk").agg(F.first("leaves").alias("leaves"), F.first("counts").alias("counts"))
    met = one.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("chunk", "leaves", "counts"))).alias("functions"))
    plans = materialize(arrow_map(met.select("id", "mark", F.col("id").cast("string").alias("name"), "functions"), resolve, f"id {kind}, mark long, n long, form string, cuts array<struct<which:int,chunk:int,entry:int,number:long>>"), "infill-plans")
    wanted = plans.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.explode("cuts").alias("x")).select("_id", "_mark", F.col("x.chunk").alias("_chunk"), "x.which", "x.entry", "x.number")
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted.hint("merge")
    hits = chunks.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("chunk") == F.col("_chunk")))
    places = arrow_map(hits.select("id", "mark", "which", "chunk", "text", "entry", "number"), select, f"id {kind}, mark long, which int, place long")
    found = places.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(*[F.max(F.when(F.col("which") == w, F.col("place"))).alias(name) for w, name in enumerate(("first", "second"))])
    # a cut without a place is the text's end
    return plans.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("id", "mark", "n", "form", "first", "second")


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n tokens: white space and the word after it, or white
    space at the text's end.  Prefix, middle and suffix end at token bounds that
    depend on ``seed`` and the id; so does whether the form is plain (the text as
    it is), psm or spm.  Empty texts and those with a mark are plain; null
    counts as empty.  prefix_chars and middle_chars are code points, null where
    the form is plain.  Rows of one id get the same draws; repeated rows get a
    row each; an empty table gives an empty result.  Extra columns are ignored.
    """
    return _outputs(docs, id_col, text_col, seed, fim, spm, chunk, digests=False)


def infill_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``infill`` with digests in place of the output: output_sha256 and restored_sha256, of the text rebuilt from output and form."""
    return _outputs(docs, id_col, text_col, seed, fim, spm, chunk, digests=True)


def _outputs(docs: DataFrame, id_col: str, text_col: str, seed: int, fim: int, spm: int, chunk: int, digests: bool) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("form", "string"), ("first", "long"), ("second", "long"))]
    single = F.char_length("text") <= chunk
    whole = docs.where(F.char_length(text) > chunk)
    plans = materialize(infill_plans(whole, id_col, text_col, seed, fim, spm, chunk), "infill-cuts").withColumnsRenamed({"id": "_id", "mark": "_mark"})
    plans = F.broadcast(plans) if plans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plans.hint("merge")
    long = rows.where(~single).join(plans, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")))
    columns = ["id", "name", "text", "n", "form", "first", "second"]
    outputs = ["output_sha256", "restored_sha256"] if digests else ["output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, n, form, first, second in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                if form is None:  # a text of one chunk
                    data = text.encode()
                    n, form, cuts = plan_of([function_of(data)] if data else [], draws_of(seed, name), fim, spm)
                    first, second = (c and place_of(data, c[1], c[2]) for c in cuts) if cuts else (None, None)
                if form != "plain":
                    first, second = (len(text) if c is None else c for c in (first, second))
                made = rearranged(text, form, first, second)
                row = (n, form, None if form == "plain" else first, None if form == "plain" else second - first)
                out.append((*row, *((hashlib.sha256(x.encode()).hexdigest() for x in (made, restored(made, form))) if digests else (made,))))
            made = list(zip(*out)) if out else [()] * (4 + len(outputs))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(made, kinds))], names=["id", "n", "form", "prefix_chars", "middle_chars", *outputs])

    every = rows.where(single).select("id", "name", "text", *nothing).unionByName(long.select(*columns))
    return arrow_map(every, run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, {', '.join(f'{c} string' for c in outputs)}").withColumnRenamed("id", id_col)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, w, len(w) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(w) + 1) AS k1, CAST('0x' || x[9:16] AS BIGINT) % (len(w) + 1) AS k2,
    CAST('0x' || x[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS h4 FROM d
), f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 >= {FIM_PERCENT} THEN 'plain' WHEN h4 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1 : least(k1, k2)], '') AS p, array_to_string(w[least(k1, k2) + 1 : greatest(k1, k2)], '') AS m, array_to_string(w[greatest(k1, k2) + 1 :], '') AS s FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f
"""
