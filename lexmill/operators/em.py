"""IBM Model 1 by expectation maximisation on co-occurring word pairs only."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.operators.durable import durable
from lexmill.operators.picks import number_rows

#: Pairs of words of one row that a task weighs; a tol with more than HOT of them is spread over tasks.
PAIRS, HOT = 4_000_000, 8_000_000


def _coded(rows: DataFrame, key: str, words: str) -> tuple[DataFrame, DataFrame]:
    """k, the key, and words: an array of (id, m) of its words, with their multiplicities; and w, id of all words, from 0."""
    counted = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(words).alias("w")).where("w IS NOT NULL").groupBy("k", "w").agg(F.count("*").cast("int").alias("m"))
    names = durable(number_rows(counted.select("w").distinct(), ["w"]).select("w", (F.col("id") - 1).cast("int").alias("id")))
    return counted.join(names, "w").groupBy("k").agg(F.collect_list(F.struct("id", "m")).alias("words")), names  # of one row


def _deal(parts: int, hot: list[int]):
    """Rows as bytes of whole numbers: a row's en side goes once to each part that some of its tol words fall to."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(hot, np.int32)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for e, t in zip(b.column("_e"), b.column("_t"), strict=True):
                ids, m = (e.values.field(i).to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for i in (0, 1))
                words, mt = (t.values.field(i).to_numpy(zero_copy_only=False).astype(np.int32) for i in (0, 1))
                some = ~np.isin(words, apart)
                words, mt = words[some], mt[some]
                of = words % parts
                order = np.argsort(of, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
                    for column, v in zip(out, (int(of[mine[0]]), ids, m, words[mine].tobytes(), mt[mine].tobytes()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["p", "e", "me", "t", "mt"])

    return deal


def _weigh(totals: list, vocabulary: int, rounds: int, least: float):
    """A part's sums of expected counts of each en word after the rounds whose totals are known; after all of them its pairs with p of least or more.

    All rows of a tol are in its part, so its column of the table is made again from the totals, and no pair is stored or shuffled.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [c for b in batches for c in zip(*(b.column(n).to_pylist() for n in ("e", "me", "t", "mt")), strict=True)]
        if not cells:
            return
        e, me, t, mt = (np.frombuffer(b"".join(c[i] for c in cells), np.int32) for i in range(4))
        a, b = (np.array([len(c[i]) // 4 for c in cells], np.int64) for i in (0, 2))
        row = np.repeat(np.arange(len(cells)), b)
        size = a[row]  # a unit is a tol word in a row, with all en words of the row
        first = np.cumsum(size) - size
        at = np.repeat((np.cumsum(a) - a)[row] - first, size) + np.arange(size.sum())
        pairs, pair = np.unique(np.repeat(t.astype(np.int64) * vocabulary, size) + e[at], return_inverse=True)
        m, en, p, c = me[at].astype(np.float64), pairs % vocabulary, None, None
        for k in range(min(len(totals) + 1, rounds)):
            pm = m if p is None else m * p[pair]
            z = np.add.reduceat(pm, first)
            c = np.bincount(pair, pm * np.repeat(np.divide(mt, z, out=np.zeros(len(z)), where=z > 0), size), len(pairs))
            if k < len(totals):
                p = np.divide(c, totals[k].value[en], out=np.zeros(len(c)), where=c > 0)
        if len(totals) < rounds:
            words, place = np.unique(en, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(np.bincount(place, c))], ["e", "n"])
        else:
            some = np.flatnonzero(p >= least)
            yield pa.RecordBatch.from_arrays([pa.array(en[some].astype(np.int32)), pa.array((pairs[some] // vocabulary).astype(np.int32)), pa.array(p[some])], ["e", "t", "p"])

    return weigh


def model1(rows: DataFrame, key: str, en: str, tol: str, rounds: int = 5, least: float = 0.0) -> DataFrame:
    """en, tol, p (of least or more) after so many rounds from a uniform start. Null keys and words are left out.

    What is normalised in a row belongs to one tol, so rows are dealt once by their tol words, as arrays of numbers; parts have about PAIRS pairs. A
    round shuffles only each part's sums by en word; the totals, eight bytes a word of the vocabulary, go to all tasks. A tol with more than HOT pairs
    would be too much for a task: its pairs are kept as rows and joined with their table.
    """
    (left, left_names), (right, right_names) = _coded(rows, key, en), _coded(rows, key, tol)
    sides = durable(left.withColumnRenamed("words", "_e").join(right.withColumnRenamed("words", "_t"), "k"))
    load = sides.select(F.size("_e").alias("n"), F.explode("_t.id").alias("t")).groupBy("t").agg(F.sum("n").alias("n"))
    hot = [r.t for r in load.where(F.col("n") > HOT).collect()]  # fewer than all pairs by HOT
    vocabulary, pairs = left_names.count(), load.where(F.col("n") <= HOT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, ceil(pairs / PAIRS))
    dealt = durable(sides.mapInArrow(_deal(parts, hot), "p int, e binary, me binary, t binary, mt binary").repartitionById(parts, F.col("p")).drop("p"))
    totals: list = []
    occ = table = None
    if hot:
        each = sides.select("k", "_e", F.inline("_t")).where(F.col("id").isin(hot)).select("k", F.col("id").alias("t"), F.col("m").alias("mt"), F.inline("_e"))
        occ = durable(each.select("k", "t", "mt", F.col("id").alias("e"), F.col("m").alias("me")))
    for _ in range(rounds):
        sums = dealt.mapInArrow(_weigh(list(totals), vocabulary, rounds, least), "e int, n double")
        if hot:
            x = occ.withColumn("p", F.lit(1.0)) if table is None else occ.join(table, ["e", "t"])
            x = x.withColumn("z", F.sum(F.col("me") * F.col("p")).over(Window.partitionBy("k", "t")))
            soft = durable(x.groupBy("e", "t").agg(F.sum(F.col("mt") * F.col("me") * F.col("p") / F.col("z")).alias("c")))
            sums = sums.unionByName(soft.groupBy("e").agg(F.sum("c").alias("n")))
        n = durable(sums.groupBy("e").agg(F.sum("n").alias("n")))
        got = n.toPandas()
        total = np.zeros(vocabulary)
        total[got.e.to_numpy(np.int64)] = got.n
        totals.append(rows.sparkSession.sparkContext.broadcast(total))
        if hot:
            table = soft.join(n, "e").select("e", "t", (F.col("c") / F.col("n")).alias("p"))
    out = dealt.mapInArrow(_weigh(totals, vocabulary, rounds, least), "e int, t int, p double")
    if hot:
        out = out.unionByName(table.where(F.col("p") >= least))
    name = lambda names, id, w: names.select(F.col("id").alias(id), F.col("w").alias(w))
    return out.join(name(left_names, "e", "en"), "e").join(name(right_names, "t", "tol"), "t").select("en", "tol", "p")


def best_pairs(table: DataFrame, least: float = 0.1) -> DataFrame:
    """Each English word's most probable word above least, ties to the smaller."""
    return table.where(F.col("p") > least).groupBy("en").agg(F.min_by(F.struct("tol", "p"), F.struct(-F.col("p"), "tol")).alias("b")).select("en", "b.tol", "b.p")
