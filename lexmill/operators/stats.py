"""Counts, co-occurrence, marginals, bands and histograms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators.stretches import Ordered

#: Words whose grams a task counts at once, words whose grams a group sums, and a prime whose products fit 64 bits.
GRAM_WORDS, GROUP_WORDS, PRIME = 1 << 21, 1 << 19, (1 << 31) - 1


def term_counts(rows: DataFrame, words: str, keys: list[str] | None = None) -> DataFrame:
    return rows.select(*(keys or []), F.explode(words).alias("term")).groupBy(*(keys or []), "term").agg(F.count("*").alias("n"))


def document_counts(rows: DataFrame, words: str) -> DataFrame:
    """term, tf, df: each unit counts once for df.

    Each row gives its words for tf and its distinct words for df; both are exploded and counted in one pass and one
    shuffle of partial counts, linear in a row's length.
    """
    both = F.array(F.struct(F.col(words).alias("_w"), F.lit(1).alias("_t"), F.lit(0).alias("_d")), F.struct(F.array_distinct(words).alias("_w"), F.lit(0).alias("_t"), F.lit(1).alias("_d")))
    each = rows.select(F.inline(both)).select(F.explode("_w").alias("term"), "_t", "_d")
    return each.groupBy("term").agg(F.sum("_t").alias("tf"), F.sum("_d").alias("df"))


def ngram_counts(rows: DataFrame, words: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """n, gram, cnt; no gram crosses a row, and none holds a null.

    Tasks count stretches of GRAM_WORDS words as numbers: a gram's number is that of its first words and its last word, so equal
    grams are one before they become strings. Each stretch's grams are dealt as arrays, by a hash of their text, to groups of about
    GROUP_WORDS words each, whatever the table's size; a group sums the counts of its grams.
    """
    most = max(sizes)
    total = rows.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    groups = 1 + total // GROUP_WORDS

    def dealt(n: int, grams: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        group = hashes % groups
        order = np.argsort(group, kind="stable")
        found, starts = np.unique(group[order], return_index=True)
        offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, a) for a in (grams.take(pa.array(order)).cast(pa.string()), pa.array(counts[order]))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), pa.array(found), *lists], ["n", "part", "grams", "counts"])

    def counted(words: pa.Array, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts over words; row tells which belong together."""
        coded = words.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary, many = coded.dictionary, max(1, len(coded.dictionary))
        # a text's hash is the number that its bytes spell, modulo a prime: that of joined texts follows from theirs
        text = [w.encode() for w in vocabulary.to_pylist()]
        spelt, shift = (np.array(v, np.int64) for v in ([int.from_bytes(w) % PRIME for w in text], [pow(256, len(w), PRIME) for w in text]))
        at = np.flatnonzero(code >= 0)  # where a gram of the present length starts
        number, grams, hashes = code[at], vocabulary, spelt
        for n in range(1, most + 1):
            if n > 1:
                at, number = (a[at + n - 1 < len(code)] for a in (at, number))
                last = at + n - 1
                at, number = (a[(code[last] >= 0) & (row[last] == row[at])] for a in (at, number))
                both, number = np.unique(number * many + code[at + n - 1], return_inverse=True)
                first, word = both // many, both % many
                grams = pc.binary_join_element_wise(grams.take(pa.array(first)), vocabulary.take(pa.array(word)), pa.scalar(" ", pa.large_string()))
                hashes = ((hashes[first] * 256 + ord(" ")) % PRIME * shift[word] + spelt[word]) % PRIME
            if n in sizes and len(grams):
                yield dealt(n, grams, hashes, np.bincount(number, minlength=len(grams)))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def count() -> Iterator[pa.RecordBatch]:
            n = np.concatenate(lengths)
            yield from counted(pa.concat_arrays(held), np.repeat(np.arange(len(n)), n))
            held.clear()
            lengths.clear()

        for b in batches:
            held.append(b.column(0).flatten().cast(pa.large_string()))
            lengths.append(pc.list_value_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= GRAM_WORDS or sum(a.nbytes for a in held) >= 16 * GRAM_WORDS:
                yield from count()
        if held:
            yield from count()

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.chunked_array([a.flatten() for a in table.column(f).chunks], kind) for c, f, kind in (("gram", "grams", pa.string()), ("cnt", "counts", pa.int64()))})
        out = flat.group_by("gram", use_threads=False).aggregate([("cnt", "sum")])
        return pa.table({"n": pa.array(np.full(len(out), key[0].as_py(), np.int32)), "gram": out.column("gram"), "cnt": out.column("cnt_sum")})

    parts = rows.select(words).mapInArrow(stretches, "n int, part long, grams array<string>, counts array<long>")
    return parts.groupBy("n", "part").applyInArrow(summed, "n int, gram string, cnt long")


def cooccurrence(rows: DataFrame, key: str, a: str, b: str, least: int, marginal: str = "doc", keep: Column | None = None) -> DataFrame:
    """a, b, together, a_n, b_n of items that share at least so many units; a and b are array columns, one row per key.

    Items rarer than least can't qualify, so they go before pairs are made. Marginals are the items' own numbers of
    units (doc), or as inflated by the other side's size (pair: a's units times the b items of each, and the reverse).
    keep: a condition on a_n and b_n; pairs that it doesn't hold for are not made.
    """
    units = rows.select(key, F.array_distinct(a).alias("_a"), F.array_distinct(b).alias("_b"))
    weight = {"_a": F.lit(1), "_b": F.lit(1)} if marginal == "doc" else {"_a": F.size("_b"), "_b": F.size("_a")}

    def side(column: str, name: str) -> tuple[DataFrame, DataFrame]:
        each = units.select(key, F.explode(column).alias(name), weight[column].alias("_w"))
        n = each.groupBy(name).agg(F.sum("_w").cast("long").alias(f"{column[1]}_n"), F.count("*").alias("_u")).where(F.col("_u") >= least).drop("_u")
        return each.drop("_w").join(n if keep is not None else n.select(name), name), n

    (left, left_n), (right, right_n) = side("_a", a), side("_b", b)
    met = left.join(right, key) if keep is None else left.join(right, key).where(keep)
    together = met.groupBy(a, b).agg(F.count("*").alias("together")).where(F.col("together") >= least)
    return together.join(left_n, a).join(right_n, b).select(a, b, "together", "a_n", "b_n")


def threshold_counts(keys: list[str], score: Column, cuts: dict[str, Column]) -> list[Column]:
    """Aggregates: rows, mean score, and a conditional count for each named condition."""
    return [F.count("*").alias("n"), F.avg(score).alias("mean_score"), *(F.count_if(c).alias(name) for name, c in cuts.items())]


def bucket(score: Column, buckets: int = 10) -> Column:
    """Half-open buckets of [0, 1]; 1 is in the last."""
    return F.least(F.floor(score * buckets).cast("int"), F.lit(buckets - 1))


def upper_median(rows: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """The element at n // 2 of each key's sorted values. Equal values are counted first; then the first value whose running count passes n // 2 is taken, by stretches where a key has very many values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_m"))
    scan = Ordered(counted, keys, [value], most).scan(_upto=("sum", F.col("_m")), _n=("total", F.col("_m")))
    half = F.floor(F.col("_n") / 2)
    return scan.rows.where((F.col("_upto") > half) & (F.col("_upto") - F.col("_m") <= half)).select(*keys, F.col(value).alias("upper_median"))


def skeletons(rows: DataFrame, words: str) -> DataFrame:
    """first, last, cnt: the first two and last two words of units of four words or more."""
    w = F.col(words)
    ends = rows.where(F.size(w) >= 4).select(F.array_join(F.slice(w, 1, 2), " ").alias("opening"), F.array_join(F.slice(w, -2, 2), " ").alias("ending"))
    return ends.groupBy("opening", "ending").agg(F.count("*").alias("cnt"))


def affix_counts(rows: DataFrame, words: str, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """kind, affix, cnt over all words, one pass."""
    tests = [F.when(F.col("w").startswith(p), F.struct(F.lit("prefix").alias("kind"), F.lit(p).alias("affix"))) for p in prefixes]
    tests += [F.when(F.col("w").endswith(s), F.struct(F.lit("suffix").alias("kind"), F.lit(s).alias("affix"))) for s in suffixes]
    each = rows.select(F.explode(words).alias("w")).select(F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull())))
    return each.groupBy("kind", "affix").agg(F.count("*").alias("cnt"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def contexts(rows: DataFrame, a: str, b: str, top: int | None = 3) -> DataFrame:
    """a, b, context, cnt: for every two words of aligned units the other words of a's side, sorted, at most top of them; with top None a digest of them all.

    With a whole context, a word and its context are one to one with a's side, so b's words are counted by a digest of that side, and
    what a side's words and b's words make together is neither shuffled nor stored.
    """
    whole = lambda w: F.sha2(F.array_join(F.array_remove("_a", w), " "), 256)  # noqa: E731 - sorted once a row
    few = lambda w: F.array_join(F.slice(F.array_remove(F.slice("_a", 1, top + 1), w), 1, top), " ")  # noqa: E731 - the first ones of the others are among the first of all and one more
    context = whole if top is None else few
    sides = rows.select(F.array_sort(F.array_distinct(a)).alias("_a"), F.array_distinct(b).alias("_b"))
    if top is None:
        sides = sides.withColumn("_s", F.unhex(F.sha2(F.array_join("_a", " "), 256)))
        counts = sides.select("_s", F.explode("_b").alias("b_word")).groupBy("_s", "b_word").agg(F.count("*").alias("cnt"))
        each = sides.groupBy("_s").agg(F.first("_a").alias("_a")).select("_s", F.inline(F.transform("_a", lambda w: F.struct(w.alias("a_word"), context(w).alias("context")))))
        return counts.join(each, "_s").select("a_word", "b_word", "context", "cnt")
    # contexts are made within the first generator's input: once for each word of a's side, not again for each of b's
    units = sides.select(F.inline(F.transform("_a", lambda w: F.struct(w.alias("a_word"), context(w).alias("context")))), "_b")
    return units.select("a_word", "context", F.explode("_b").alias("b_word")).groupBy("a_word", "b_word", "context").agg(F.count("*").alias("cnt"))
