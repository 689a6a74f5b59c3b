"""Toxicity severity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector shared by ordered
thresholds theta_0 < theta_1 < ...; the expected severity is the sum of those
probabilities.  Features are sparse: logarithmic counts of words and of word
beginnings that tell the grades of a bounded labelled sample apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import arrow_map, materialize

#: Labelled rows that the model is fitted on, chosen by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Features that reach the driver, fewest rows and least |z| of one.
MAX_FEATURES, MIN_ROWS, MIN_Z = 4096, 5, 4.0
#: Code points of a word's beginning.
STEM = 4
#: Grades of toxic texts; 0 is for clean ones.
TOXIC_GRADES = 3

_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().encode().translate(_TABLE).decode().split()


def stems_of(words: Iterable[str]) -> list[str]:
    """Beginnings of the distinct longer words; the star keeps them apart from words."""
    return [w[:STEM] + "*" for w in words if len(w) > STEM]


@dataclass
class Model:
    """Features by name, their weights and the ordered thresholds."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, text: str | None) -> dict[int, int]:
        words, get = Counter(words_of(text)), self.features.get
        found = {k: n for w, n in words.items() if (k := get(w)) is not None}
        found.update(Counter(k for s in stems_of(words) if (k := get(s)) is not None))
        return found

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        score = sum(self.weights[k] * math.log1p(n) for k, n in self.counts(text).items())
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -500, 500)))


def fit_ordinal(rows: list[dict[int, int]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 2e-5, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the penalised negative log-likelihood (Adam, whole batches)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((k for r in rows for k in r), dtype=np.int64, count=len(at))
    val = np.log1p(np.fromiter((n for r in rows for n in r.values()), dtype=np.float64, count=len(at)))
    n, cuts = len(rows), n_grades - 1
    w = np.zeros(n_features)
    share = np.clip([(grades > k).mean() for k in range(cuts)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # theta_0 and the logarithms of the gaps after it: the order can't break
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    params = np.concatenate([w, raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(at, weights=w[col] * val, minlength=n)
        up = np.where(grades > 0, sigmoid(score - theta[np.maximum(grades - 1, 0)]), 1.0)
        down = np.where(grades < cuts, sigmoid(score - theta[np.minimum(grades, cuts - 1)]), 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = np.where(grades > 0, up * (1 - up), 0) / p, np.where(grades < cuts, down * (1 - down), 0) / p
        slope = -(d_up - d_down) / n
        g_w = np.bincount(col, weights=slope[at] * val, minlength=n_features) + l2 * w
        g_theta = (np.bincount(np.maximum(grades - 1, 0), weights=d_up, minlength=cuts)[:cuts] - np.bincount(np.minimum(grades, cuts - 1), weights=d_down, minlength=cuts)[:cuts]) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * np.exp(raw[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = params[n_features:]
    return params[:n_features], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled ids, chosen by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(known), "_id").select("text", "y")  # bounded: ``rows`` rows of two numbers


def choose_features(sample: DataFrame, limit: int = MAX_FEATURES) -> list[tuple[str, int, int]]:
    """(feature, toxic rows, clean rows) of those that tell toxic from clean rows best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words, toxic = set(words_of(text.as_py())), int(y.as_py() > 0)
                seen[toxic].update(words)
                seen[toxic].update(set(stems_of(words)))
                rows[toxic] += 1
        seen[1][""], seen[0][""] = rows[1], rows[0]  # how many rows there are
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[x] for x in names], pa.int64()) for s in (seen[1], seen[0]))], names=["f", "t", "c"])

    sums = materialize(arrow_map(sample, run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "features")
    whole = sums.where(F.col("f") == "").first()
    if whole is None or not whole.t or not whole.c:
        return []
    n, base = whole.t + whole.c, whole.t / (whole.t + whole.c)
    k = F.col("t") + F.col("c")
    z = (F.col("t") - k * F.lit(base)) / F.sqrt(k * F.lit(base * (1 - base)) * (1 - k / F.lit(n + 1.0)))
    best = sums.where((F.col("f") != "") & (k >= MIN_ROWS)).withColumn("z", z).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "f").limit(limit)
    return [(r.f, r.t, r.c) for r in best.collect()]  # ``limit`` rows at most


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of severity grades 0 (clean) to TOXIC_GRADES.

    ``labels`` says 0 or 1.  A toxic row's grade is its third by how many words
    it has that the sample knows almost only from toxic rows.  Without rows of
    both kinds (empty tables too) the model has no features and calls everything
    clean.  Labels without an id or a label don't count; of repeated ones each does.
    """
    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows), "toxic-sample")
    chosen = choose_features(sample)
    none = Model({}, np.zeros(0), np.full(TOXIC_GRADES, 40.0))
    if not chosen:
        return none
    shell = Model({f: k for k, (f, _, _) in enumerate(chosen)}, np.zeros(0), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shell.counts(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["y", "k", "n"])

    got = arrow_map(sample, run, "y int, k array<int>, n array<int>").collect()  # ``sample_rows`` rows of few numbers
    rows, y = [dict(sorted(zip(r.k, r.n))) for r in got], np.array([int(r.y > 0) for r in got])
    order = sorted(range(len(rows)), key=lambda i: (y[i], sorted(rows[i].items())))  # whatever order the tasks had
    rows, y = [rows[i] for i in order], y[order]
    harsh = {k for k, (f, t, c) in enumerate(chosen) if t >= 9 * c and not f.endswith("*")}
    strength = np.array([sum(n for k, n in r.items() if k in harsh) for r in rows])
    steps = np.quantile(strength[y > 0], [g / TOXIC_GRADES for g in range(1, TOXIC_GRADES)])
    grades = np.where(y > 0, 1 + (strength[:, None] > steps[None]).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(rows, grades, len(chosen), TOXIC_GRADES + 1)
    return Model(shell.features, weights, thresholds)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, severity (expected grade), grade (nearest), p_toxic, toxic (p_toxic >= 0.5).

    A null or empty text has no features and is scored as such (clean).  A
    severity half-way between two grades goes to the even one.  Repeated rows get
    a row each; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.above(t.as_py()) for t in batch.column(1)]).reshape(-1, len(model.thresholds))
            severity = p.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], names=["id", "severity", "grade", "p_toxic", "toxic"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns, of any name, as they were.

    A row at exactly p_toxic = 0.5 goes.  A null or empty text is clean;
    repeated rows share their fate; an empty table gives an empty result.
    """
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.above(t.as_py())[0] < 0.5 for t in batch.column(k)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = None  # a fitted model: tested by held-out accuracy
