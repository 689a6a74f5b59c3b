"""Vectors of texts: a pluggable encoder, or hashed TF-IDF where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from normgraph.operators.tfidf import hashed_vectors, tfidf

#: Texts that an encoder gets at once.
BATCH = 32


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], id_col: str = "id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(id, vector) with vectors of length 1; ``encoder`` maps texts to rows of a matrix on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                m = np.asarray(encoder([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64)
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(m), pa.list_(pa.float64()))], names=["id", "vector"])

    rows = texts.select(texts[id_col].alias("id"), texts[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def hashed_tfidf(texts: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 512) -> DataFrame:
    """(id, vector) without a model; texts without terms have none."""
    return hashed_vectors(tfidf(texts, id_col, text_col), size)
