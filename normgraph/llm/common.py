"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.storage import materialize, new_path, release, scope, scoped, settled, shared_dir, written

__all__ = ["arrow_map", "free_name", "lean", "materialize", "new_path", "release", "scope", "scoped", "settled", "shared_dir", "text_or_empty", "weighted_lookup", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: \x20 and \x09-\x0D, the white space of every contract here.
WHITE = " \t\n\x0b\x0c\r"

#: Rows of fixed-width values, or their like, up to which a table is broadcast
#: (about 8 MB serialised); larger ones take a shuffled join.
BROADCAST_ROWS = 200_000
#: A key is heavy when it holds more than 1 / HEAVY of all rows, so there are
#: never more than HEAVY such keys: that is the proven bound of their broadcast.
HEAVY = 2000
#: Bytes of a batch that an Arrow kernel gets.
ARROW_BYTES = 8 << 20
#: Parts that the rows of a heavy key are dealt to.
SALTS = 32


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and their heaps with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, limit: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``limit`` bytes; a longer row stands alone."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        yield batch
        return
    sizes = np.full(batch.num_rows, 16, np.int64)
    rest = batch.nbytes
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            own = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            sizes += own
            rest -= int(own.sum())
    sizes += max(0, rest) // batch.num_rows  # other columns: alike in every row
    number = (np.cumsum(sizes) - 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts, cuts[1:]):
        yield batch.slice(s, e - s)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in slices(batch))
        finally:
            give_back()

    return wrapped


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, giving memory back when a task ends.

    Kernels get batches of about ARROW_BYTES, whatever the session's limits on
    batches are; those stay as they are.
    """
    return df.mapInArrow(lean(run), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def weighted_lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", width: Column | None = None) -> DataFrame:
    """Join ``left`` to ``right``, whose ``keys`` are unique and not null, safely under skew.

    ``weight`` holds how many rows of ``left`` a key of ``right`` has, ``total``
    how many rows ``left`` has and ``width`` how many fixed-width values a row
    of ``right`` stands for (1 by default).  A right side of at most
    ``BROADCAST_ROWS`` such values is broadcast.  Beyond that both sides are
    shuffled; only the heavy keys themselves (see above) are broadcast, to deal
    their rows to SALTS parts.  ``how`` is ``inner`` or ``left``.
    """
    size = right.agg(F.coalesce(F.sum(width if width is not None else F.lit(1)), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    heavy = F.col(weight) * F.lit(HEAVY) > F.lit(total)
    hot = F.broadcast(right.where(heavy).select(*keys, F.lit(True).alias("_hot")))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(hot, keys, "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_hot"), F.col("_part")).otherwise(0)).drop("_hot")
    copies = right.withColumn("_part", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
