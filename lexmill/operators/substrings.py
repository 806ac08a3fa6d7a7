"""Substring evidence: which terms stand in which texts, and in how many units two terms stand together.

Terms are sought by an Aho–Corasick automaton: one pass over a text finds all of them, in time linear in the text and its
matches, where a condition on substrings alone would be a nested-loop join. Terms come in blocks of bounded size, each held by
the tasks for one scan; counts are added up in the tasks, so what is shuffled are sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.operators.durable import durable

#: Pairs of a block, and characters of their terms.
BLOCK_PAIRS, BLOCK_CHARS = 200_000, 1 << 21
#: Runs of a task whose terms are kept, and characters of one.
RUNS, RUN_CHARS = 1 << 17, 32


class Finder:
    """The distinct terms that a text holds.

    A term stands within a run of characters that terms have. Short runs come again and again, so what they hold is kept, in bounded memory.
    """

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        chars = sorted({c for t in terms for c in t})
        self.runs = re.compile("[" + "".join(map(re.escape, chars)) + "]+") if chars else None
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        if not text or self.runs is None:
            return set()
        found: set[int] = set()
        for run in set(self.runs.findall(text)):
            held = self.known.get(run)
            if held is None:
                held = tuple({i for _, i in self.automaton.iter(run)})
                if len(run) <= RUN_CHARS:
                    if len(self.known) >= RUNS:
                        self.known.clear()
                    self.known[run] = held
            found.update(held)
        return found


def blocks_of(pairs: DataFrame, columns: list[str]) -> list[DataFrame]:
    """The distinct rows without nulls and empty terms, in blocks within the bounds (by a hash, so of about equal sizes)."""
    kept = durable(pairs.select(*(F.lower(c).alias(c) for c in columns)).where(" AND ".join(f"`{c}` <> ''" for c in columns)).distinct())
    n, chars = kept.agg(F.count("*"), F.coalesce(F.sum(sum(F.length(c) for c in columns)), F.lit(0))).first()
    blocks = max(1, ceil(1.25 * max(n / BLOCK_PAIRS, chars / BLOCK_CHARS)))
    return [kept if blocks == 1 else kept.where(F.pmod(F.xxhash64(*columns), F.lit(blocks)) == i) for i in range(blocks)]


def evidence(pairs: DataFrame, units: DataFrame, a: str, b: str, left: str, right: str, least: int = 1) -> DataFrame:
    """a, b, evidence: the distinct pairs of terms of which the first is a substring of left and the second of right in at least so many units.

    Case is folded on both sides. Null and empty terms are no pairs, null texts hold no term; repeated units each count; an empty table
    on either side gives no rows. A term that is found costs a text its partners, as whole arrays.
    """
    spark = units.sparkSession
    rows = units.select(F.lower(left).alias("_l"), F.lower(right).alias("_r")).where("_l IS NOT NULL AND _r IS NOT NULL")
    return reduce(DataFrame.unionByName, [_block_evidence(spark, block, rows, a, b) for block in blocks_of(pairs, [a, b])]).where(F.col("evidence") >= least)


def _block_evidence(spark, block: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    asked = [(r[0], r[1]) for r in block.select(a, b).collect()]  # of BLOCK_PAIRS rows and BLOCK_CHARS characters, about
    terms = sorted({t for p in asked for t in p})
    at = {t: i for i, t in enumerate(terms)}
    asked.sort(key=lambda p: at[p[0]])
    first, second = (np.array([at[p[i]] for p in asked], np.int64) for i in (0, 1))
    starts = np.searchsorted(first, np.arange(len(terms) + 1))  # a term's pairs lie together
    shared = spark.sparkContext.broadcast((asked, terms, second, starts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, terms, second, starts = shared.value
        find, counts, held = Finder(terms), np.zeros(len(asked), np.int64), np.zeros(len(terms), bool)
        for batch in batches:
            for x, y in zip(batch.column("_l").to_pylist(), batch.column("_r").to_pylist(), strict=True):
                one = find(x)
                other = one if x == y else find(y) if one else one
                if not other:
                    continue
                i, j = np.fromiter(one, np.int64, len(one)), np.fromiter(other, np.int64, len(other))
                n = starts[i + 1] - starts[i]
                pairs = np.repeat(starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
                held[j] = True
                counts[pairs[held[second[pairs]]]] += 1
                held[j] = False
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([asked[i][0] for i in some], pa.string()), pa.array([asked[i][1] for i in some], pa.string()), pa.array(counts[some])], ["a", "b", "n"])

    found = rows.mapInArrow(count, "a string, b string, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("evidence")).select(F.col("a").alias(a), F.col("b").alias(b), "evidence")


def holding(terms: DataFrame, term: str, rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and term for each distinct term that is a substring of the row's text, both folded; as LIKE '%term%' says, for all terms in one scan a block."""
    spark = rows.sparkSession
    texts = rows.select(F.col(key).alias("_key"), F.lower(text).alias("_t"))
    kind = rows.schema[key].dataType.simpleString()

    def of(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(sorted(r[0] for r in block.select(term).collect()))  # of BLOCK_PAIRS rows and BLOCK_CHARS characters, about

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                hits = [sorted(finder(t)) for t in batch.column("_t").to_pylist()]
                keys = batch.column("_key").take(pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits])))
                yield pa.RecordBatch.from_arrays([keys, pa.array([shared.value[i] for h in hits for i in h], pa.string())], ["_key", "term"])

        return texts.mapInArrow(find, f"_key {kind}, term string").select(F.col("_key").alias(key), F.col("term").alias(term))

    return reduce(DataFrame.unionByName, [of(block) for block in blocks_of(terms, [term])])
