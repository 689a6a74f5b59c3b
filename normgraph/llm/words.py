"""Words of whole texts as Arrow columns, in parts of bounded size.

Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z has been
lower-cased.  A text longer than a part is cut between two words and goes on in
the next part, so that no text is too long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are no word characters become spaces, A-Z become a-z.
TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a part, about.
PART_BYTES = 4 << 20

#: The same words in DuckDB SQL, of a column named text.
WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@dataclass(frozen=True)
class Part:
    """Words of the rows from ``row`` on; row k's are words[offsets[k] : offsets[k + 1]].

    ``again`` says that the part goes on with the text that the part before it ended in.
    """

    row: int
    offsets: np.ndarray
    words: pa.Array
    again: bool = False


def _split(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words of the texts that end at ``ends`` of ``data``."""
    clean = pa.py_buffer(data.translate(TABLE))
    texts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), clean)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    places = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return before[places], words.filter(full)


def word_parts(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[Part]:
    """Words of ``texts`` (null: none), every row's in order."""
    texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = memoryview(buffer) if buffer is not None else memoryview(b"")
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        start, end = int(offsets[row]), int(offsets[stop])
        if end - start <= limit:
            yield Part(row, *_split(bytes(data[start:end]), offsets[row : stop + 1] - start))
        else:  # one long text
            again = False
            while start < end:
                cut = end if end - start <= limit else _cut(data, start + limit, end)
                yield Part(row, *_split(bytes(data[start:cut]), np.array([0, cut - start])), again)
                start, again = cut, True
        row = stop


def _cut(data: memoryview, at: int, end: int) -> int:
    """The first place from ``at`` on that isn't inside a word."""
    found = BETWEEN.search(data, at, end)
    return found.start() if found else end
