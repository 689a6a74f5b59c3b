"""License scans by an exact set-similarity join with templates.

Text blocks are all windows of BLOCK words, one beginning at each word; a
template of more than half of that has windows of twice its words.  A block
meets a template when it holds at least THRESHOLD of the template's distinct
words.  Words are ordered by their frequency over all documents, rarest first;
then, with need = the words that have to be shared,

* prefix filter: one of the template's first |T| - need + 1 words must be in the
  block, so only blocks around such words are looked at: they make stretches of
  text, and a stretch holds all blocks that have its prefix words;
* length filter: a stretch has need of the template's words at least;
* positional filter: what stands before and after a prefix word, in the template
  and in the stretch, must leave need words in common.

A stretch that is left has its blocks' words counted by sliding over it, one
word in and one out.  Words of no template can't be shared, so they are left
out; this keeps all three filters exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.common import LOWER, UPPER, arrow_map
from normgraph.llm.words import TABLE

#: Contract: phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices as their publishers word them; a parameter, of a bounded size.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = Fraction(9, 10)
BLOCK = 64


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def template_sets(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text.encode()))) for label, text in templates]


def windows_of(templates, block: int) -> list[int]:
    """Words of the windows that each template is sought in: ``block``, twice its own for a longer one."""
    return [max(block, 2 * len(words_of(text.encode()))) for _, text in templates]


def need_of(size: int, threshold: Fraction = THRESHOLD) -> int:
    return math.ceil(size * threshold)


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of ``vocabulary`` stands; as many rows as it has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(vocabulary.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in counts.collect()}


class TemplateIndex:
    """Templates' words by global order, their prefixes, and the windows they are sought in."""

    def __init__(self, templates, frequencies: dict[bytes, int], threshold: Fraction = THRESHOLD, widths: list[int] | None = None):
        vocabulary = sorted({w for _, s in templates for w in s}, key=lambda w: (frequencies.get(w, 0), w))
        self.order = {w: k for k, w in enumerate(vocabulary)}
        self.templates, self.prefix = [], {}
        for t, (label, words) in enumerate(templates):
            ranked, need = sorted(self.order[w] for w in words), need_of(len(words), threshold)
            self.templates.append((label, {w: i for i, w in enumerate(ranked)}, need, widths[t] if widths else BLOCK))
            for w in ranked[: len(ranked) - need + 1]:
                self.prefix.setdefault(w, []).append(t)
        #: A text without any of these words has no block that meets a template.
        self.rare = frozenset(w for w, k in self.order.items() if k in self.prefix)

    def met(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, largest containment) of the templates that a block of ``words`` meets."""
        places: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            k = self.order.get(w)
            if k is not None:
                places.setdefault(k, []).append(at)
        starts: dict[int, list[int]] = {}
        for k in places.keys() & self.prefix.keys():
            for t in self.prefix[k]:
                starts.setdefault(t, []).extend(places[k])
        for t, around in starts.items():
            label, ranks, need, width = self.templates[t]
            own = sorted((at, i) for k, i in ranks.items() for at in places.get(k, ()))
            shared = max((self._most(stretch, len(ranks), need, width) for stretch in _stretches(own, sorted(around), width)), default=0)
            if shared >= need:
                yield label, shared / len(ranks)

    @staticmethod
    def _most(stretch: list[tuple[int, int]], n: int, need: int, width: int) -> int:
        """The most distinct words of one template in a window of a stretch, 0 if the filters rule it out."""
        there = sorted({i for _, i in stretch})
        if len(there) < need:  # length
            return 0
        # position: words before and after a prefix word that both may have
        if all(1 + min(n - i - 1, len(there) - j - 1) + min(i, j) < need for j, i in enumerate(there) if i < n - need + 1):
            return 0
        inside, most, first = Counter(), 0, 0
        for at, i in stretch:
            inside[i] += 1
            while stretch[first][0] <= at - width:
                gone = stretch[first][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                first += 1
            most = max(most, len(inside))
        return most


def _stretches(places: list[tuple[int, int]], around: list[int], width: int) -> Iterator[list[tuple[int, int]]]:
    """``places`` within a window of each of ``around``, both ordered; windows that overlap go together."""
    low = 0
    at = 0
    while at < len(around):
        begin, end = around[at] - width + 1, around[at] + width - 1
        while at + 1 < len(around) and around[at + 1] - width + 1 <= end:
            at += 1
            end = around[at] + width - 1
        at += 1
        while low < len(places) and places[low][0] < begin:
            low += 1
        high = low
        while high < len(places) and places[high][0] <= end:
            high += 1
        yield places[low:high]
        low = high


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    places = []
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                places.append((at, label))
    return places


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: Fraction = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are maximal runs of 0-9, a-z and non-ASCII characters after A-Z has
    been lower-cased.  n_base counts the places where a phrase's words stand
    one after the other, first_word and last_word are the smallest and largest
    of them (null without any).  labels adds the labels of the templates that a
    block meets; score is the largest containment found, 1 where a phrase
    stands, 0 without any.  Windows have ``block`` words, twice a template's
    words where it has more than half of that, so templates may be of any length.
    A null text counts as empty; extra columns are ignored; repeated rows get a
    row each; an empty table gives an empty result.
    """
    sets = template_sets(templates)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    frequencies = word_frequencies(rows, frozenset(w for _, s in sets for w in s))
    index = TemplateIndex(sets, frequencies, threshold, windows_of(templates, block))
    sought = [(words_of(p.encode()), label) for p, label in phrases]
    sought = [(p, label) for p, label in sought if p]  # one without words stands nowhere
    ends = frozenset(p[-1] for p, _ in sought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                distinct = set(words)
                places = [] if ends.isdisjoint(distinct) else phrase_places(words, sought)
                score, base = float(bool(places)), {label for _, label in places}
                labels = set(base)
                if not index.rare.isdisjoint(distinct):
                    for label, share in index.met(words):
                        labels.add(label)
                        score = max(score, share)
                starts = [at for at, _ in places]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return arrow_map(rows, run, schema).withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """Every block that begins with a template's word against the template, without filters."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"({t}, {quote(w.decode())})" for t, (_, s) in enumerate(template_sets()) for w in sorted(s))
    sizes = ", ".join(f"({t}, {quote(label)}, {len(s)}, {need_of(len(s))}, {width})" for t, ((label, s), width) in enumerate(zip(template_sets(), windows_of(TEMPLATES, BLOCK))))
    phrase = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT * FROM (VALUES {phrase}) AS p(phrase, label, k)),
b AS (
  SELECT rid, label, i - 1 AS place FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0), p
  WHERE array_to_string(w[i : i + k - 1], ' ') = phrase
), v AS (SELECT * FROM (VALUES {words}) AS v(t, word)), z AS (SELECT * FROM (VALUES {sizes}) AS z(t, label, size, need, width)),
u AS (SELECT rid, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS place FROM d WHERE len(w) > 0),
c AS (SELECT rid, t FROM u JOIN v USING (word) JOIN z USING (t) GROUP BY rid, t, need HAVING count(DISTINCT word) >= need),
k AS (SELECT rid, t, word, place, width, place // width AS part FROM u JOIN v USING (word) JOIN z USING (t) JOIN c USING (rid, t)),
m AS (
  SELECT rid, label, shared / size AS share FROM (
    SELECT a.rid, a.t, a.place, count(DISTINCT b.word) AS shared FROM (SELECT *, unnest([part, part + 1]) AS near FROM k) a JOIN k b ON a.rid = b.rid AND a.t = b.t AND b.part = a.near AND b.place >= a.place AND b.place < a.place + a.width GROUP BY ALL
  ) JOIN z USING (t) WHERE shared >= need
), bb AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid
), ll AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT rid, label, share FROM m UNION ALL SELECT rid, label, 1 FROM b) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN ll USING (rid)
"""


SQL = _sql()
