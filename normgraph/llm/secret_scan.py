"""Secret scans over an incremental blob ledger.

A version's text is addressed by its SHA-256.  The ledger holds, for each blob
and rule version, what the scan found.  A run scans only the pairs that no
ledger row has, once per blob however many paths carry it, and appends them,
found or not.  Findings are then joined from the ledger back to every path of
every version.  A pair that two runs appended at once stands twice and counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normgraph.llm.common import BROADCAST_ROWS, free_name, materialize, new_path, text_or_empty, weighted_lookup
from normgraph.sources import exists


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``'s matches whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base kinds, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: What this scan adds: tokens with well-known prefixes and private key headers.
EXTRA_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
#: Cheap necessary conditions: a text without the literal can't match the rule.
#: hex is asked for its 32 characters at once: a match is a maximal run.
GATES = {"access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "github": "gh[pousr]_", "slack": "xox[abprs]-", "google": "AIza", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}
RULES = BASE_RULES + EXTRA_RULES
#: To be raised with any change of the rules above.
RULE_VERSION = 1
#: Numbers that are summed up in one go, see running_sums.
SUM_CHUNK = 512
#: Versions that the query's documents come in.
VERSIONS = 2

FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()),
    T.StructField("rule_version", T.IntegerType()),
    T.StructField("found", T.ArrayType(FOUND)),
])


def blob_of(text_col: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def running_sums(a: Column, chunk: int = SUM_CHUNK) -> Column:
    """Sums of an array's numbers up to each place.

    Spark appends to an array by copying it, so sums are made within chunks and
    of whole chunks: the work per number is bounded by a chunk, not by the array.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    upto = lambda part: F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x)))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(chunk)), lambda at: upto(F.slice(a, at, chunk)))
    start = F.struct(zero.alias("total"), F.array().cast("array<array<long>>").alias("done"))
    add = lambda acc, part: F.struct((acc["total"] + F.coalesce(F.try_element_at(part, F.lit(-1)), zero)).alias("total"), F.concat(acc["done"], F.array(F.transform(part, lambda x: x + acc["total"]))).alias("done"))
    return F.flatten(F.aggregate(parts, start, add, lambda acc: acc["done"]))


SPAN = "array<struct<start:bigint,rule:int,kind:string,end:bigint>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """A rule's spans in code points.

    Spark has no function for the places of all matches, so they come from the
    lengths of what lies between them: a match ends after all gaps and matches
    up to it.
    """
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, w: F.struct((F.char_length(b) + F.char_length(w)).cast("long").alias("step"), F.char_length(w).alias("len")))
    steps = F.transform(lengths, lambda x: x["step"])
    each = F.zip_with(F.arrays_zip(running_sums(steps).alias("end"), lengths.alias("x")), group, lambda e, g: F.struct((e["end"] - e["x"]["len"]).alias("start"), F.lit(order).alias("rule"), F.lit(rule.kind).alias("kind"), e["end"].alias("end"), F.char_length(g).alias("size")))
    kept = F.transform(F.filter(each, lambda x: x["size"] >= rule.least), lambda x: F.struct(x["start"], x["rule"], x["kind"], x["end"]))
    return F.when(text.rlike(GATES.get(rule.kind, rule.pattern)), kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_secrets(blobs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) for the blobs with findings; built-in functions only, each row by itself."""
    text = text_or_empty(text_col)
    spans = blobs.select("blob", F.array_sort(F.concat(*[_spans(text, r, k) for k, r in enumerate(rules)])).alias("s")).where(F.size("s") > 0)
    return spans.select("blob", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))


def paths_of(versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(path, blob) of every row."""
    return materialize(versions.select(F.col(id_col).alias("path"), blob_of(text_col).alias("blob")), "paths")


def scan_unseen(versions: DataFrame, paths: DataFrame, ledger: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ledger rows of the blobs that ``ledger`` lacks under this rule version, one for each, found or not.

    One row of each unseen blob is scanned, however often it repeats.  A path
    that one row has names its blob, so rows are chosen by path and no text is
    hashed again; rows without a path, or with one that several rows have, are
    hashed, and the first of each blob taken.
    """
    alone = paths.where(F.col("path").isNotNull()).groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("blob").alias("blob")).where("rows = 1")
    blobs = paths.select("blob").distinct().join(alone.groupBy("blob").agg(F.min("path").alias("rep")), "blob", "left")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    unseen = materialize(blobs, "unseen")
    texts = versions.select(F.col(id_col).alias("path"), F.col(text_col).alias("_text"))
    want = unseen.where(F.col("rep").isNotNull()).select(F.col("rep").alias("_p"))
    # Where the paths to skip are few they are broadcast, so that no text is
    # shuffled; else the paths to take are joined by an ordinary shuffle.
    skip = paths.where(F.col("path").isNotNull()).select(F.col("path").alias("_p")).distinct().join(want, "_p", "left_anti")
    skip = materialize(skip, "skipped")
    if skip.limit(broadcast_rows + 1).count() <= broadcast_rows:
        chosen = texts.where(F.col("path").isNotNull()).join(F.broadcast(skip), F.col("path") == F.col("_p"), "left_anti")
    else:
        chosen = texts.join(want.hint("merge"), F.col("path") == F.col("_p"), "left_semi")
    found = find_secrets(chosen.select(F.col("path").alias("blob"), "_text"), "_text", rules).withColumnRenamed("blob", "rep")
    found = unseen.where(F.col("rep").isNotNull()).join(found, "rep").select("blob", "found")
    others = unseen.where(F.col("rep").isNull()).select("blob")
    if not others.isEmpty():
        shared = paths.join(others, "blob", "left_semi").select(F.col("path").alias("_p")).distinct()
        rows = texts.join(shared, F.col("path").eqNullSafe(F.col("_p")), "left_semi").select(blob_of("_text").alias("blob"), "_text")
        first = rows.join(others, "blob", "left_semi").dropDuplicates(["blob"])
        found = found.unionByName(find_secrets(first, "_text", rules))
    new = unseen.select("blob").join(materialize(found, "found"), "blob", "left")
    return new.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("found", F.array().cast(T.ArrayType(FOUND))).alias("found"))


def open_ledger(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(ledger_path) if exists(spark, ledger_path) else None


def update_ledger(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks and append it; gives (path, blob) of ``versions``.

    A null text counts as empty; ids may be null or repeat with other texts (a
    path's history).  An empty table appends nothing.
    """
    paths = paths_of(versions, id_col, text_col)
    ledger = open_ledger(versions.sparkSession, ledger_path)
    new = scan_unseen(versions, paths, ledger, id_col, text_col, rules, rule_version, broadcast_rows)
    new.write.mode("append").parquet(ledger_path)
    return paths


def findings(paths: DataFrame, ledger_path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """(path, blob, found) of every row of ``paths``, joined from the ledger.

    found is an array of (kind, start, end) ordered by start and then by rule,
    empty without any.  Rows that stand twice in the ledger count once.
    """
    ledger = open_ledger(paths.sparkSession, ledger_path)
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    known = ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).groupBy("blob").agg(F.min("found").alias("found"))
    weighed = materialize(known.join(counts, "blob"), "weighed")
    result = weighted_lookup(paths, weighed, ["blob"], "n", paths.count(), "left", 2 + F.size("found"))
    return result.select("path", "blob", F.coalesce("found", F.array().cast(T.ArrayType(FOUND))).alias("found"))


def scan_versions(versions: list[DataFrame], ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """(id, blob, found) of every row of all versions, which are taken into the ledger one after the other.

    Nulls, repeated rows and an empty table: as ``update_ledger`` and
    ``findings`` say; every input row has one result row.  Extra columns are
    ignored.
    """
    every = None
    for version in versions:
        paths = update_ledger(version, ledger_path, id_col, text_col, rules, rule_version)
        every = paths if every is None else every.unionByName(paths)
    return findings(every, ledger_path, rule_version).withColumnRenamed("path", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with each found secret's characters replaced by ``mark``.

    Blobs that the ledger at ``ledger_path`` knows aren't scanned again; without
    a path a ledger of this run's own is used.  Overlapping spans are replaced
    together.  Rows without secrets keep their text as it was, null included;
    repeated rows are each rewritten; extra columns of any name pass through; an
    empty table gives an empty result.
    """
    key, blob, found = (free_name(docs, n) for n in ("_key", "_blob", "_found"))
    ledger_path = ledger_path or new_path(docs.sparkSession, "ledger")
    paths = update_ledger(docs, ledger_path, id_col, text_col, rules)
    hits = findings(paths.select(F.lit(None).alias("path"), "blob").distinct(), ledger_path).where(F.size("found") > 0).select(F.col("blob").alias(blob), F.col("found").alias(found))
    hits = materialize(hits, "secret-blobs")
    rows, spans = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(found)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS // 4 and spans <= BROADCAST_ROWS // 2:
        hits = F.broadcast(hits)
    joined = docs.withColumn(key, blob_of(text_col)).join(hits, F.col(key) == F.col(blob), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def pass_over(acc: Column, span: Column) -> Column:
        between = F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.greatest(span["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(span["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mark)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    done = F.aggregate(found, start, pass_over, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"].cast("int") + 1, F.lit(2_147_483_647))))
    return joined.withColumn(text_col, F.when(F.col(blob).isNotNull(), done).otherwise(F.col(text_col))).drop(key, blob, found)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a ledger, as versions that come one after the other: what an earlier one held isn't scanned again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(VERSIONS))
    found = scan_versions([docs.where(turn == k) for k in range(VERSIONS)], new_path(spark, "ledger"))
    return digests(found)


def digests(found: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(_joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """Places by the same arithmetic, but over every row and without a ledger."""
    parts = []
    for order, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {order} AS o, '{r.kind}' AS kind, {r.least} AS least, i, length(b) AS gap, length(w) AS len, length(g) AS size FROM ("
            f"SELECT rid, unnest(string_split_regex(text, '{pattern}')) AS b, unnest(regexp_extract_all(text, '{pattern}')) AS w, unnest(regexp_extract_all(text, '{pattern}', {r.group})) AS g, "
            f"unnest(generate_series(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM d WHERE regexp_matches(text, '{pattern}')) WHERE w IS NOT NULL"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), m AS (" + " UNION ALL ".join(parts) + "), "
        "e AS (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY rid, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM m), "
        "s AS (SELECT rid, o, kind, e - len AS b, kind || ':' || (e - len) || ':' || e AS t FROM e WHERE size >= least) "
        "SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        f"sha256(coalesce(string_agg(t, ',' ORDER BY b, o) FILTER (o < {len(BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY b, o), '') AS spans "
        "FROM d LEFT JOIN s USING (rid) GROUP BY rid"
    )


SQL = _sql()
