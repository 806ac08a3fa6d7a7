"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of BLOCK words of a text, half overlapping the next one, so that every passage of up to
BLOCK / 2 words lies in one whole. A block meets a template when it holds at least THRESHOLD of the
template's distinct words. Words are ordered by their document frequency over the whole corpus, rarest first:
only blocks that hold a word of a template's prefix can meet it (prefix filter), blocks with too few template
words cannot (length filter), nor can those whose remaining words after a shared one are too few (positional
filter). What passes is verified on the whole sets, so the join is exact.

The templates' words are a fixed, small vocabulary, so their frequencies are all that the driver gathers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import small_batches

# Phrases of the base labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices of public licenses, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
BLOCK, THRESHOLD = 64, 0.8

#: ASCII letters to lower case, all other ASCII but digits to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class TemplateIndex:
    """Prefix index of the templates under a word order."""

    def __init__(self, templates: tuple = TEMPLATES, frequency: dict[str, int] | None = None, threshold: float = THRESHOLD, block: int = BLOCK) -> None:
        frequency = frequency or {}
        self.block, self.step = block, block // 2
        vocabulary = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(vocabulary)}
        self.templates = []  # label, set of ranks, least overlap
        self.prefix: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, (label, text) in enumerate(templates):
            ranks = sorted({self.rank[w.encode()] for w in text.split()})
            least = ceil(threshold * len(ranks) - 1e-9)
            self.templates.append((label, frozenset(ranks), least))
            for i, r in enumerate(ranks[: len(ranks) - least + 1]):
                self.prefix.setdefault(r, []).append((k, i, len(ranks), least))
        self.rare = [b" " + w + b" " for w, r in self.rank.items() if r in self.prefix]

    def matches(self, words: list[bytes], spaced: bytes) -> dict[str, float]:
        """Label of each template that a block of the words meets, and the best containment."""
        if not any(w in spaced for w in self.rare):
            return {}
        ranks = [self.rank.get(w, -1) for w in words]
        found: dict[str, float] = {}
        blocks = sorted({b for i, r in enumerate(ranks) if r in self.prefix for b in (i // self.step, max(0, i // self.step - 1))})
        for b in blocks:
            held = sorted({r for r in ranks[b * self.step : b * self.step + self.block] if r >= 0})
            overlap: dict[int, int] = {}
            for j, r in enumerate(held):
                for k, i, size, least in self.prefix.get(r, ()):
                    so_far = overlap.get(k, 0)
                    if so_far < 0 or len(held) < least:
                        continue
                    left = min(size - i - 1, len(held) - j - 1)
                    overlap[k] = so_far + 1 if so_far + 1 + left >= least else -1
            for k, n in overlap.items():
                label, ranks_of, least = self.templates[k]
                if n > 0 and (shared := len(ranks_of.intersection(held))) >= least:
                    found[label] = max(found.get(label, 0.0), shared / len(ranks_of))
        return found


def phrase_places(words: list[bytes], spaced: bytes) -> list[tuple[int, str]]:
    """(first word's place, label) of every place where a phrase's words stand consecutively."""
    found = []
    if b" license " in spaced or b" by " in spaced:
        for phrase, label in PHRASES:
            sought = f" {phrase} ".encode()
            at, counted, words_before = spaced.find(sought), 0, 0
            while at >= 0:
                words_before += spaced.count(b" ", counted, at)
                counted = at
                found.append((words_before, label))
                at = spaced.find(sought, at + 1)
    return sorted(found)


def frequencies(docs: DataFrame, templates: tuple = TEMPLATES, *, text: str = "text") -> dict[str, int]:
    """Document frequency, over all rows, of each word of the templates: as many rows as they have words."""
    small_batches(docs.sparkSession)
    vocabulary = frozenset(w.encode() for _, t in templates for w in t.split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                n.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return dict(docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect())


def scan_licenses(docs: DataFrame, index: TemplateIndex | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its words, base places and labels, the labels with those of the method, and a score.

    The score is 1 with a base label, else the best containment that met the threshold, else 0. Null and empty
    texts: no words, places null, no labels, 0. Rows are repeated as they come, null keys stay; other columns are not read, so
    their names don't matter. Whole texts are scanned, whatever their length, in time linear in it; of templates met alike all labels
    count. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    index = index or TemplateIndex(frequency=frequencies(docs, text=text))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for t in b.column("_text").cast(pa.binary()).to_pylist():
                words = words_of(t)
                spaced = b" " + b" ".join(words) + b" "
                places = phrase_places(words, spaced)
                base = {label for _, label in places}
                found = index.matches(words, spaced)
                row = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | found.keys())), 1.0 if base else max(found.values(), default=0.0))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(scan, f"_key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("_key", key)


def op10_license_scans(docs: DataFrame) -> DataFrame:
    """Every document under the templates and phrases of this module; odd cases are as scan_licenses states."""
    return scan_licenses(docs)


def op10_sql() -> str:
    """The same result in DuckDB SQL, by brute force over all blocks and templates."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))})" for label, t in TEMPLATES)
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    half = BLOCK // 2
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, tw) AS (VALUES {templates}), p(label, pw) AS (VALUES {phrases}),
starts AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
hits AS (SELECT doc_id, label, i FROM starts JOIN p ON w[i + 1] = pw[1] AND w[i + 1 : i + len(pw)] = pw),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(w[b * {half} + 1 : b * {half} + {BLOCK}]) AS bw FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {half} - 1) // {half})) AS b FROM d)),
met AS (SELECT doc_id, label, max(len(list_intersect(bw, tw)) / len(tw)) AS c FROM blocks, t GROUP BY doc_id, label HAVING max(len(list_intersect(bw, tw)) / len(tw)) >= {THRESHOLD} - 1e-9),
found AS (SELECT doc_id, list(label) AS labels, max(c) AS c FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(found.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""
