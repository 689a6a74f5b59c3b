"""The pipeline against a brute-force version of each stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from normgraph.llm import packing, secret_scan, toxicity
from normgraph.storage import written
from tests.conftest import rows_of
from tests.llm.helpers import clashing, documents
from tests.llm.test_operators import brute_near, check_bins

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(texts):
    held = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            key = line.strip(WHITE).translate(LOWER)
            if len(key) >= 20:
                held[key].add(i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if keep.get(x.strip(WHITE).translate(LOWER), i) == i) for i, t in texts.items()}


def brute_redact(text):
    spans = []
    for r in secret_scan.RULES:
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m[r.group]) >= r.least:
                spans.append(m.span())
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect() if model.above(r.text)[0] < 0.5}
    texts = brute_lines(texts)
    texts = {i: texts[i] for i, (_, c) in brute_near(texts, 5).items() if c == i}
    return {i: brute_redact(t) for i, t in texts.items()}


def test_pipeline_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    before = written(spark)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    expected = {}
    for i, text in brute(spark, sf_dir).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], dtype="<u4")
            expected[i, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    assert check_bins([(r.sequence_id, r.offset, r.length) for r in got], 4096) <= -(-sum(r.length for r in got) // 4096) + 1
    assert before <= written(spark)


def awkward(spark):
    line = "a line of more than twenty characters"
    texts = [None, "", "plain text of a few words", "password=abcdefgh1 here", "plain text of a few words", "plain text of a few words", "no other row has this text at all", "plain text of a few words", f"{line}\nx y", f"{line}\nx z", line]
    ids = [1, None, 4, 5, 6, None, None, 4, 8, 9, None]
    return clashing(documents(spark, texts, ids).withColumn("lang", F.lit(None).cast("string")))


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = awkward(spark)
    line = "a line of more than twenty characters"
    kept = {
        "toxicity": 11,
        "line_dedup": 11,
        "near_dedup": 9,  # the copies of 6 and of no id go, both rows of 4 stay
        "secret_scan": 11,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        assert out.count() == kept[name], name
        assert out.where("lang IS NOT NULL").count() == 0
    near = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect() if r.text and r.text.startswith(("plain", "no ")))
    assert near == [(0, "no other row has this text at all"), (4, "plain text of a few words"), (4, "plain text of a few words")]
    lines = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).where("doc_id IN (8, 9)").collect()}
    assert lines == {8: "x y", 9: f"{line}\nx z"}
    assert corpus_pipeline.redact_secrets(spark, docs, sf_dir).where("text = '[SECRET] here' AND n_chars = 13").count() == 1
    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert packed.count() == 11 and packed.where("doc_id IS NULL").count() == 4


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_pipeline_leaves_only_its_last_tables(spark, sf_dir):
    before = written(spark)
    out = corpus_pipeline.run(spark, sf_dir)
    names = {p.rsplit("/", 1)[-1].split("-")[0] for p in written(spark) - before}
    assert names <= {"stage", "pieces"} and out.count() > 0


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secret_scan", "packing"]


def test_operators_in_threads_of_one_session(spark, sf_dir):
    """Each leaves its own tables alone, and a failed one nothing; the session's settings stay."""
    from concurrent.futures import ThreadPoolExecutor

    from normgraph.llm.queries import queries
    from normgraph.storage import release, scope, scoped, written

    names = ["op8_minhash_dedup", "op4_secret_scan", "op9_line_dedup"]
    found = queries() | {"pipeline": corpus_pipeline.run}
    with scope(spark, keep=False):
        alone = {n: rows_of(found[n](spark, sf_dir)) for n in names}
    before, settings = written(spark), dict(spark.conf.getAll)

    def failing(name):
        def fail(s, d):
            found[name](s, d).count()
            raise ValueError("stop")

        return scoped(fail)

    def work(task):
        name, fails = task
        try:
            return rows_of((failing(name) if fails else found[name])(spark, sf_dir))
        except ValueError:
            return None

    tasks = [(n, False) for n in [*names, "pipeline"]] + [(n, True) for n in [*names, "pipeline"]]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(work, tasks))
    assert got[:3] == [alone[n] for n in names] and got[3] and got[4:] == [None] * 4
    assert dict(spark.conf.getAll) == settings
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("normgraph_")]
    release(spark, keep=before)
    assert written(spark) == before
