"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context, written out before it, and only that reply is trainable.  Written out,
the examples of a conversation grow with the square of its turns; a context of
any length is written in parts of a bounded size, so no row and no batch grows
with it.  Turns after the last reply form a last example without a trainable
part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normgraph.llm.common import arrow_map, materialize

#: Marks of the template: a turn is START role SEP text END.
START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: The first two characters of any control string: of this template, and of
#: those that tokenizers and other templates commonly know (<s>, </s>, <bos>,
#: <eos>, <unk>, <pad>, <mask>, <start_of_turn>, <end_of_turn>, <<SYS>>, <|...|>,
#: [INST], [/INST], [TOOL_CALLS], [SYSTEM_PROMPT], [AVAILABLE_TOOLS], ...).  A
#: backslash between them keeps a text from holding one.
CONTROL = r"(<)(?=[|/<A-Za-z])|(\[)(?=[/A-Z])|(\\)"
TRAINABLE = "assistant"
#: Characters of a context's part.
PART = 1_000_000
#: Characters after which rows are handed on.
BATCH_CHARS = 4_000_000

EXAMPLES = "example long, part int, context string, text string, context_chars long, loss_start long, loss_end long"


def escape(text: str) -> str:
    """``text`` with a backslash inside each control string and every backslash doubled."""
    return re.sub(CONTROL, lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """(conv, example, part, context, text, context_chars, loss_start, loss_end), one example per assistant turn.

    An example is its context (all preceding turns) and then its text: the turns
    since the last reply and the reply itself.  A context of ``part`` characters
    or more comes in rows of ``part`` characters each, from part 0 on; the last
    row has the rest of it and the text, which is null in the others.
    context_chars are the code points of the whole context; loss_start and
    loss_end bound the reply inside text (both null in a last example without
    one, and in all rows without a text).  A null text or role counts as empty;
    turns are ordered by turn (null first), then role and text, so repeated
    turns all stay.  Rows with a null conversation form one.  Extra columns are
    ignored; an empty table gives an empty result.  A conversation is formatted
    in one task, in one pass that holds its text once.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = _Nothing, _Conversation(part)
        out: list[tuple] = []
        size = 0

        def examples() -> Iterator[tuple]:
            nonlocal conv, at
            for batch in batches:
                for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                    if c != conv:
                        yield from at.rest()
                        conv, at = c, _Conversation(part)
                    yield from at.turn(role, text)
            yield from at.rest()

        for row in examples():
            out.append((conv, *row))
            size += len(row[2]) + len(row[3] or "")
            if size > BATCH_CHARS:
                yield _batch(out, names, types)
                out, size = [], 0
        yield _batch(out, names, types)

    kind = rows.schema["conv"].dataType
    names = ["conv", "example", "part", "context", "text", "context_chars", "loss_start", "loss_end"]
    types = [_arrow(kind), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return arrow_map(ordered, run, f"conv {kind.simpleString()}, {EXAMPLES}").withColumnRenamed("conv", conv_col)


class _Conversation:
    """One conversation's examples, turn by turn."""

    def __init__(self, part: int):
        self.example, self.context_chars, self.part = 0, 0, part
        self.full: list[str] = []  # the context so far, in whole parts
        self.tail = ""
        self.parts: list[str] = []
        self.length = 0

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        """The rows of the example that this turn completes, if it does."""
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        self.parts += head, body, END
        start = self.length + len(head)
        self.length = start + len(body) + len(END)
        if role == TRAINABLE:
            yield from self.close(start, start + len(body))

    def close(self, start: int | None, end: int | None) -> Iterator[tuple]:
        text = "".join(self.parts)
        for k, piece in enumerate(self.full):
            yield self.example, k, piece, None, self.context_chars, None, None
        yield self.example, len(self.full), self.tail, text, self.context_chars, start, end
        whole = self.tail + text
        cut = len(whole) // self.part * self.part
        self.full += [whole[at : at + self.part] for at in range(0, cut, self.part)]
        self.tail = whole[cut:]
        self.example, self.context_chars, self.parts, self.length = self.example + 1, self.context_chars + self.length, [], 0

    def rest(self) -> Iterator[tuple]:
        if self.parts:
            yield from self.close(None, None)


class _Nothing:
    """Before the first conversation; no value equals it."""


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def whole_examples(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """All examples as one text each: (conv, example, text, loss_start, loss_end).

    An example of one row is taken as it is; the parts of a longer one are put
    together, so this is for examples that one value can hold.
    """
    columns = [conv_col, "example", "text", "context_chars", "loss_start", "loss_end"]
    single = (F.col("part") == 0) & F.col("text").isNotNull()
    there = examples.where(single).withColumn("text", F.concat("context", "text")).select(*columns)
    part = F.struct("part", F.concat("context", F.coalesce("text", F.lit(""))).alias("t"))
    grouped = examples.where(~single).groupBy(conv_col, "example").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("context_chars").alias("context_chars"), F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"))
    made = grouped.withColumn("text", F.array_join(F.transform("parts", lambda x: x["t"]), "")).select(*columns)
    every = there.unionByName(made)
    return every.select(conv_col, "example", "text", *[(F.col(c) + F.col("context_chars")).alias(c) for c in ("loss_start", "loss_end")])


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Before:
    """What precedes an example, as the length and digest of each of its parts."""

    def __init__(self, part: int):
        self.part, self.chars, self.full = part, 0, []
        self.size, self.digest = 0, hashlib.sha256()

    @property
    def last(self) -> int:
        return len(self.full)

    def piece(self, number: int) -> tuple[int, str]:
        return (self.part, self.full[number]) if number < len(self.full) else (self.size, self.digest.hexdigest())

    def add(self, text: str) -> None:
        self.chars += len(text)
        at = 0
        while at < len(text):
            take = text[at : at + self.part - self.size]
            self.digest.update(take.encode())
            self.size, at = self.size + len(take), at + len(take)
            if self.size == self.part:
                self.full.append(self.digest.hexdigest())
                self.size, self.digest = 0, hashlib.sha256()


def read_back(examples: DataFrame, conv_col: str = "conv_id", part: int = PART) -> DataFrame:
    """Per conversation what its formatted examples say: turns and trainable text.

    Each part of a context is read where it lies and goes on as its digest and
    length, so it is never shuffled: the parts must be what precedes the
    example, whose turns beyond them are the conversation's next ones.  What is
    under the loss mask is trainable.  Hashes are fed in one pass over ordered
    rows; of a long conversation only a digest for each part of ``part``
    characters is held.  formatted_chars is the length of all examples with
    their contexts.
    """
    spark = examples.sparkSession
    digest = F.sha2(F.col("context").cast("binary"), 256)
    rows = examples.select(F.col(conv_col).alias("conv"), "example", "part", digest.alias("context"), F.char_length("context").cast("long").alias("length"), "text", "context_chars", "loss_start", "loss_end")
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "example", "part")
    turn = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before, next_part = _Nothing, None, _Before(part), 0
        for batch in batches:
            out = []
            for c, example, number, context, length, text, chars, start, end in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if next_part:
                        raise ValueError("a conversation's last example has no end")
                    if state:
                        out.append((conv, *closed(state)))
                    conv, state, before, next_part = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], _Before(part), 0
                if chars != before.chars or number != next_part or (length, context) != before.piece(number) or (text is None) != (number < before.last):
                    raise ValueError(f"the context of example {example} isn't what precedes it")
                next_part += 1
                if text is None:
                    continue
                next_part = 0
                for m in turn.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if start is not None:
                    reply = unescape(text[start:end])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                state[4] += chars + len(text)
                before.add(text)
            yield _batch(out, names, types)
        if next_part:
            raise ValueError("a conversation's last example has no end")
        if state:
            yield _batch([(conv, *closed(state))], names, types)

    closed = lambda s: (s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])
    kind = rows.schema["conv"].dataType
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return arrow_map(ordered, run, f"conv {kind.simpleString()}, {DIGEST}").withColumnRenamed("conv", conv_col)


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    examples = materialize(format_chats(turns.unionByName(extra)), "examples", codec="zstd")  # contexts repeat each other
    return read_back(examples)


def _sql() -> str:
    """Turns and replies from the input itself; lengths by the template's marks."""
    marks = len(START) + len(SEP) + len(END)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_CASE}'
), w AS (
  SELECT *, {marks} + length(role) + length(text) + {_added('role')} + {_added('text')} AS size FROM t
), o AS (
  SELECT *, sum(size) OVER c AS upto,
         max(CASE WHEN role = '{TRAINABLE}' THEN rn END) OVER (PARTITION BY conv_id) AS last_reply
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM w)
  WINDOW c AS (PARTITION BY conv_id ORDER BY rn)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINABLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = '{TRAINABLE}'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = '{TRAINABLE}'), 0) + CASE WHEN coalesce(any_value(last_reply), 0) < count(*) THEN max(upto) ELSE 0 END AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def _added(column: str) -> str:
    """SQL for the backslashes that escaping adds: one after each backslash, and each < or [ that could begin a control string."""
    follows = lambda first, second: f"len(regexp_extract_all({column}, '{first}{second}'))"
    runs = f"coalesce(list_sum(list_transform(regexp_extract_all({column}, '<<+'), lambda x: length(x) - 1)), 0)"
    return f"(length({column}) - length(replace({column}, '\\', '')) + {follows('<', '[|/A-Za-z]')} + {follows('[[]', '[/A-Z]')} + {runs})"


SQL = _sql()
