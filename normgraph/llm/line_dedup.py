"""Line dedup over levelled sorted runs of line hashes.

Batches of documents are taken in descending order of id.  A batch's distinct
line hashes are merge-anti-joined with the runs written so far: a hash that no
run has is new, and its largest document of this batch is its keeper for good;
a hash that is known only adds to the count.  The batch becomes a run of its
own; when a level holds ``fanout`` runs they are merged into one run of the next
level.  Runs are bucketed tables, dealt and sorted by hash once when they are
written, so that later batches merge with them bucket by bucket without
shuffling or sorting them again.  At the end the runs say which lines repeat and
where each of them stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import LOWER, UPPER, WHITE, free_name, materialize, text_or_empty, weighted_lookup
from normgraph.storage import materialize_bucketed, ordered_buckets, settled

#: Second seed of the 128-bit line hash.
SALT = 7_046_029_254_386_353_131
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hash_of(key: Column) -> tuple[Column, Column]:
    """128 bits of a line's key as two longs."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SALT), key).alias("h2")


class LineRuns:
    """Levelled runs: (h1, h2, keeper, n_docs), each bucketed and ordered by hash.

    Only the row of a hash's first run has a keeper; later rows carry null.
    """

    def __init__(self, fanout: int = 3, buckets: int | None = None):
        self.fanout, self.buckets = fanout, buckets
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def runs(self) -> list[tuple[DataFrame, str]]:
        """Tables and their paths."""
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        if self.buckets is None:
            # as many as shuffles have, so that a batch's own sums are dealt the same way
            self.buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return materialize_bucketed(rows, name, HASH, self.buckets)

    def add(self, postings: DataFrame) -> None:
        """Add one batch of (doc, h1, h2), whose docs precede all earlier ones."""
        rows = postings.groupBy(*HASH).agg(F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("n_docs"))
        known = F.lit(False)
        for k, (run, _) in enumerate(self.runs()):
            # unmatched rows are the anti-join's; matched ones stay for their counts
            seen = run.select(*HASH, F.lit(True).alias(f"in_{k}")).hint("merge")
            rows, known = rows.join(seen, list(HASH), "left"), known | F.col(f"in_{k}").isNotNull()
        own = rows.select(*HASH, F.when(~known, F.col("keeper")).alias("keeper"), "n_docs")
        level, run = 0, self._write(own, "line-run-0")
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._write(self._merged(self.levels[level]), f"line-run-{level + 1}")
            self.levels[level] = []
            level += 1

    @staticmethod
    def _merged(runs: list[tuple[DataFrame, str]]) -> DataFrame:
        """One row for each hash of the runs."""
        table = runs[0][0]
        rows = table.sparkSession.read.schema(table.schema).parquet(*[path for _, path in runs])
        return rows.groupBy(*HASH).agg(F.max("keeper").alias("keeper"), F.sum("n_docs").alias("n_docs"))

    def repeated(self, min_docs: int) -> DataFrame:
        """Hashes that at least ``min_docs`` documents have, with their keeper."""
        return self._merged(self.runs()).where(F.col("n_docs") >= min_docs)


def line_postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2), one row for each document and distinct key that counts."""
    keys = F.filter(F.transform(F.split(text_or_empty(text_col), "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    # told apart as strings, which array_distinct looks up in a hash set; hashes come after that
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(keys)).alias("key"))
    return rows.select("doc", *hash_of(F.col("key")))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, keeper, n_docs) of the keys that at least ``min_docs`` rows hold."""
    postings = materialize(line_postings(docs, id_col, text_col, min_chars), "line-postings")
    cuts = postings.agg(F.percentile_approx("doc", [k / batches for k in range(batches - 1, 0, -1)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    runs = LineRuns(fanout)
    above = None
    for cut in [*cuts, None]:
        part = postings
        if cut is not None:
            part = part.where(F.col("doc") >= cut)
        if above is not None:
            part = part.where((F.col("doc") < above) if cut is not None else (F.col("doc") < above) | F.col("doc").isNull())
        runs.add(part)
        above = cut
    return runs.repeated(min_docs)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, mark, gone array of line numbers): what rows lose; others are absent.

    mark is a hash of the text: it tells rows of one id apart.
    """
    spark = docs.sparkSession
    with ordered_buckets(spark):  # everything that reads the runs is written before this ends
        repeated = settled(spark, "line-repeats", lambda: repeated_lines(docs, id_col, text_col, min_chars, min_docs, batches, fanout))
    # the mark is taken below the generator, once a text
    marked = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).alias("text"))
    lines = marked.select("doc", "mark", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = lines.select("doc", "mark", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars).select("doc", "mark", "at", *hash_of(F.col("key")))
    # a key's rows are at least its lines' documents: the weight only has to find the heavy keys
    total = repeated.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hits = weighted_lookup(keyed, repeated, list(HASH), "n_docs", total).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return hits.groupBy("doc", "mark").agg(F.collect_list("at").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus n_lines and n_dropped (long).

    A text is split at ``\\n``; null or empty gives one empty line.  A key of at
    least ``min_chars`` code points that at least ``min_docs`` rows hold loses
    its lines everywhere but in the rows of the largest id that holds it.  Other
    lines stay as they were.  Repeated rows count one by one; a null id is below
    every other and, where only null ids hold a key, its lines stay.  Extra
    columns pass through unless they are named n_lines or n_dropped, which are
    replaced.  An empty table gives an empty result.  Work on a text grows with
    its length, however many lines it has.
    """
    doc_name, mark_name, gone_name, kept_name = (free_name(docs, n) for n in ("_doc", "_mark", "_gone", "_kept"))
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    gone = materialize(gone.withColumnsRenamed({"doc": doc_name, "mark": mark_name, "gone": gone_name}), "line-gone")
    # what documents lose grows with the input, so this is a shuffled join at any size
    base = docs.drop("n_lines", "n_dropped")
    joined = base.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(doc_name)) & (F.xxhash64(text_or_empty(text_col)) == F.col(mark_name)), "left")
    lines, loses = F.split(text_or_empty(text_col), "\n", -1), F.col(gone_name).isNotNull()
    # array_except looks numbers up in a hash set and keeps the order
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_name))
    joined = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn(kept_name, F.when(loses, numbers))
    joined = joined.withColumn("n_dropped", F.when(loses, F.col("n_lines") - F.size(kept_name)).otherwise(F.lit(0)).cast("long"))
    rest = F.array_join(F.transform(F.arrays_zip(F.array(lines).alias("l"), F.array(F.col(kept_name)).alias("k")), lambda x: F.array_join(F.transform(x["k"], lambda i: F.get(x["l"], i)), "\n")), "")
    joined = joined.withColumn(text_col, F.when(loses, rest).otherwise(text_or_empty(text_col)))
    return joined.drop(doc_name, mark_name, gone_name, kept_name)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, i, ls[i] AS line,
         translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)
), r AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3
), f AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id IS DISTINCT FROM r.keeper AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid
"""
