"""Decontamination, importance resampling and infilling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normgraph.llm import decontaminate, importance, infilling, words
from tests.conftest import rows_of
from tests.llm.helpers import AWKWARD, clashing, documents
from tests.llm.test_operators import items


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 20])
def test_parts_hold_every_word_once(limit):
    found = {}
    for part in words.word_parts(pa.array(AWKWARD, pa.string()), limit):
        for k in range(len(part.offsets) - 1):
            found.setdefault(part.row + k, []).extend(part.words[part.offsets[k] : part.offsets[k + 1]].to_pylist())
    assert [found.get(k, []) for k in range(len(AWKWARD))] == [words_of(t) for t in AWKWARD]


# --- decontamination

POOL = "a b c d e f".split()


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return [" ".join(rng.choice(POOL) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def contamination_by_hand(docs, bench, window):
    found = []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item, t in bench:
            v = words_of(t)
            k = min(window, len(v))
            sought = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in sought:
                    hit.update(range(p, p + k))
                    names.add("" if item is None else str(item))
        found.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("group_words, limit", [(2_000_000, 1 << 20), (30, 1 << 20), (2_000_000, 24), (25, 16)])
def test_contamination_by_hand(spark, group_words, limit):
    """With one group of items and several, whole texts and pieces that overlap."""
    docs = list(enumerate([*AWKWARD, *random_texts(1, 40, 60), *random_texts(1, 5, 60)])) + [(None, "a b c d e f a b"), (None, None)]
    bench = [(r.item_id, r.text) for r in items(spark).collect()] + list(enumerate(random_texts(2, 12, 14), 100))
    frame = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    tests = clashing(spark.createDataFrame(bench, "item_id long, text string"))
    found = decontaminate.contamination(frame, tests, window=5, group_words=group_words, limit=limit)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=repr)
    assert rows == contamination_by_hand(docs, bench, 5)
    clean = {r[0] for r in rows if not r[-1] and r[0] is not None}
    kept = decontaminate.remove_contaminated(frame, tests, window=5, group_words=group_words, limit=limit)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} - {None} == clean


def longest_by_hand(docs, bench, window):
    found = {}
    for item, t in bench:
        v = words_of(t)
        for s in range(max(1, len(v) - window + 1) if v else 0):
            best = None
            for i, text in docs:
                w = words_of(text)
                for p in range(len(w)):
                    k = 0
                    while s + k < len(v) and p + k < len(w) and v[s + k] == w[p + k]:
                        k += 1
                    if k >= min(window, len(v)):
                        best = min(best or (1,), (-k, i, p))
            if best:
                found["" if item is None else str(item), " ".join(v[:window]), s] = (-best[0], best[1], best[2])
    return found


@pytest.mark.parametrize("group_words, limit", [(2_000_000, 1 << 20), (30, 1 << 20), (2_000_000, 24)])
def test_longest_matches_by_hand(spark, group_words, limit):
    pool = random_texts(3, 30, 80)
    rng = random.Random(4)
    bench = [(k, " ".join(words_of(t)[5 : 5 + rng.randint(4, 40)])) for k, t in enumerate(random_texts(3, 12, 80))] + list(enumerate(random_texts(5, 6, 20), 50)) + [(90, "a b"), (91, None)]
    docs = list(enumerate(pool + pool[:7])) + [(99, " ".join(pool)), (98, None)]
    found = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), window=4, group_words=group_words, limit=limit)
    rows = {(r.item_id, r.item_words, r.item_start): (r.length, r.doc_id, r.doc_start) for r in found.collect()}
    assert rows == longest_by_hand(docs, bench, 4)


def test_decontamination_of_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert decontaminate.contamination(none_docs, items(spark)).count() == 0
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, none_items).collect()) == [(0, 0, False), (2, 0, False)]
    assert decontaminate.remove_contaminated(docs, none_items).count() == 2
    assert decontaminate.longest_matches(docs, none_items).count() == 0


def test_decontamination_takes_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("x", "some a b c d"), ("y", "d c b a")], "name string, body string")
    tests = spark.createDataFrame([("q-2", "b c d"), ("q-10", "A B c")], "key string, words string")
    found = decontaminate.contamination(docs, tests, "name", "body", "key", "words", window=3).orderBy("name").collect()
    assert [(r.name, r.n_hit, r.items_sha256) for r in found] == [("x", 4, hashlib.sha256(b"q-10,q-2").hexdigest()), ("y", 0, hashlib.sha256(b"").hexdigest())]


# --- importance resampling


def features_of(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled_by_hand(docs, target, n, buckets, seed, min_words, share):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features_of(text, n):
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        own = [gain[zlib.crc32(f.encode()) % buckets] for f in features_of(text, n)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n, max_nodes, limit", [(1, 500_000, 1 << 20), (2, 500_000, 1 << 20), (2, 5, 30), (3, 20, 17), (4, 500_000, 64)])
def test_resampling_by_hand(spark, monkeypatch, n, max_nodes, limit):
    """Tries that are given up often and texts in many parts count the same."""
    monkeypatch.setattr(importance.WordTrie.__init__, "__defaults__", (n, 100, None, max_nodes))
    docs = list(enumerate([*AWKWARD, *random_texts(1, 40, 60)])) + [(None, "a b c d e f " * 5), (3, "a b c " * 9), (3, "a b c " * 9)]
    target = [*random_texts(7, 9, 30), None, ""]
    frame, aim = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame([(t,) for t in target], "text string"))
    gains = importance.bucket_gains(importance.bucket_totals(frame, n=n, buckets=100, max_nodes=max_nodes, limit=limit), importance.bucket_totals(aim, n=n, buckets=100, max_nodes=max_nodes, limit=limit), 100)
    expected = resampled_by_hand(docs, target, n, 100, 9, 10, 40)
    found = importance.scored(frame, gains, n=n, seed=9, max_nodes=max_nodes, limit=limit)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found.collect()), key=repr) == sorted((r[:4] for r in expected), key=repr)
    found = importance.resample(frame, aim, share=40, min_words=10, n=n, buckets=100, seed=9)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr) == expected


def test_resampling_of_empty_tables_and_drawn_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(list(enumerate(random_texts(1, 40, 60))), "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    found = importance.resample(docs, none, min_words=5, share=50)
    drawn = {r.doc_id for r in found.collect() if r["rank"]}
    assert len(drawn) == sum(len(words_of(t)) >= 5 for t in random_texts(1, 40, 60)) * 50 // 100
    kept = importance.drawn_documents(clashing(docs), none, min_words=5, share=50)
    assert {r.doc_id for r in kept.collect()} == drawn and kept.columns == clashing(docs).columns


# --- infilling

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = st.text(alphabet="a<PSM> \n\té\U0001f600", max_size=40)


def infilled_by_hand(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def composed(text, chunk):
    total = infilling.IDENTITY
    for at in range(0, len(text), chunk):
        total = infilling.compose(total, infilling.function_of(text[at : at + chunk].encode()))
    return total


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(1, 12))
def test_functions_of_chunks_compose_to_the_text_s(text, chunk):
    leaves, counts = composed(text, chunk)
    assert counts[0] == len(TOKEN.findall(text))
    assert (leaves[0] % 4 == 3) == any(m in text for m in ("<P>", "<S>", "<M>"))
    # the short way of long chunks is the automaton's
    kinds = infilling.CLASS_OF[np.frombuffer(text.encode(), np.uint8)]
    slow, fast = infilling.run_over(kinds, np.arange(infilling.STATES)), infilling.function_of(text.encode())
    assert all((x == y).all() for x, y in zip(slow, fast))


@settings(max_examples=100, deadline=None)
@given(ALPHABET, ALPHABET, ALPHABET)
def test_composition_is_associative(a, b, c):
    f, g, h = (infilling.function_of(x.encode()) for x in (a, b, c))
    left, right = infilling.compose(infilling.compose(f, g), h), infilling.compose(f, infilling.compose(g, h))
    assert all((x == y).all() for x, y in zip(left, right))


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm", "plain"]))
def test_outputs_give_the_text_back(text, a, b, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        form = "plain"
    a, b = sorted((a, b))
    assert infilling.restored(infilling.rearranged(text, form, a, b), form) == text


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_infilling_by_hand(spark, chunk):
    """Texts of one chunk and of thousands come out the same."""
    rng = random.Random(3)
    texts = [*AWKWARD[:10], *AWKWARD[12:], "x" * 3000 if chunk == 1 else AWKWARD[10], *("".join(rng.choice("ab <P \n>") for _ in range(rng.randint(0, 200))) for _ in range(40)), "a <P> b", "a <P", "> b", " ", "a "]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, "one two three four"), (None, None), (5, "another text of an id that is there")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = infilling.infill(frame, fim=90, chunk=chunk).collect()
    expected = [(i, *infilled_by_hand(i, t, fim=90)) for i, t in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr) == sorted(expected, key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infilling_of_an_empty_table(spark):
    assert infilling.infill(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_infilling_digests_match_sql(spark, tmp_path, chunk):
    from tests.conftest import duck_rows

    clashing(documents(spark, AWKWARD + AWKWARD)).write.parquet(f"{tmp_path}/documents.parquet")
    found = infilling.infill_digests(spark.read.parquet(f"{tmp_path}/documents.parquet"), chunk=chunk)
    assert rows_of(found) == duck_rows(infilling.SQL, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
