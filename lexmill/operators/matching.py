"""Sequential matching and alignment: rows are streamed to tasks in order, never gathered in arrays of rows.

A key's decisions depend on each other, so a key is worked off by one task; what that task holds of it are plain numbers in
numpy arrays (eight bytes a point), and what it returns leaves it as it is made.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lexmill.operators.sequences import proportional_targets, structs


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of equal keys in batches that are sorted by the key, and whether a run begins its key."""
    before, any_yet = None, False
    for b in batches:
        keys = b.column(key).to_pylist()
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield not any_yet or keys[at] != before, b.slice(at, end - at)
            before, any_yet, at = keys[at], True, end


def streamed(targets: DataFrame, points: DataFrame, key: str, order: str, target: str, point: str) -> DataFrame:
    """_kind, key, order, v: a key's points by value, then its targets in their order; a key's rows follow each other in one partition. Null points and targets go.

    Rows are dealt by a hash of the key: where both sides come out of joins on the key they already are dealt by the key itself, each in its
    own number of merged partitions, and Spark would leave the exchange out.
    """
    kind = targets.schema[order].dataType
    spots = points.where(F.col(point).isNotNull()).select(F.lit(0).alias("_kind"), key, F.lit(None).cast(kind).alias(order), F.col(point).cast("long").alias("v"))
    rows = spots.unionByName(targets.where(F.col(target).isNotNull()).select(F.lit(1).alias("_kind"), key, order, F.col(target).cast("long").alias("v")))
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, "_kind", F.col(order).asc_nulls_first(), "v")


class Free:
    """Points that are still free: for each place the next free one on either side, by two union-find forests with halved paths."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.tolist()
        self.up, self.down = list(range(len(self.points) + 1)), list(range(len(self.points) + 1))  # down is shifted by one; 0 is none

    @staticmethod
    def root(forest: list[int], i: int) -> int:
        while forest[i] != i:
            forest[i] = forest[forest[i]]
            i = forest[i]
        return i

    def take(self, target: int) -> int | None:
        """The free point nearest to the target, ties to the smaller; it is free no more."""
        at = bisect_left(self.points, target)
        right, left = self.root(self.up, at), self.root(self.down, at) - 1
        if right == len(self.points) and left < 0:
            return None
        if left < 0 or right < len(self.points) and self.points[right] - target < target - self.points[left]:
            left = right
        self.up[left], self.down[left + 1] = left + 1, left
        return self.points[left]


def nearest_unused(targets: DataFrame, points: DataFrame, key: str, order: str, target: str, point: str) -> DataFrame:
    """key, order, target, point: targets take, in order, the nearest point of their key that no earlier one took, ties to the smaller; null when none is left.

    Points that are equal are points each. Keys without points give nulls, keys without targets no rows. Near-linear in a
    key's rows.
    """
    names = {c: targets.schema[c].dataType.simpleString() for c in (key, order)}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        free: Free | None = None
        for begins, b in key_runs(batches, key):
            if begins:
                held, free = [], None
            v, n = b.column("v").to_numpy(), int((b.column("_kind").to_numpy() == 0).sum())
            held += [v[:n]] if n else []
            if n < len(v):
                free = free or Free(np.concatenate(held) if held else np.zeros(0, np.int64))
                held = []
                rest = b.slice(n)
                yield pa.RecordBatch.from_arrays([rest.column(key), rest.column(order), rest.column("v"), pa.array([free.take(t) for t in v[n:].tolist()], pa.int64())], [key, order, "_target", "_point"])

    rows = streamed(targets, points, key, order, target, point)
    out = rows.mapInArrow(match, f"`{key}` {names[key]}, `{order}` {names[order]}, _target long, _point long")
    return out.withColumnsRenamed({"_target": target, "_point": point})


def boundaries(targets: np.ndarray, points: np.ndarray) -> np.ndarray:
    """One of the sorted points for each of the sorted targets, in order and no point twice, with the least sum of squared distances; ties to the earlier points.

    With fewer points than targets each takes the point nearest to it, or itself without points. A solution that is found
    greedily bounds how far any target can reach, so only points within that reach are weighed.
    """
    m, n = len(targets), len(points)
    if n < m:
        if not n:
            return targets
        at = np.clip(np.searchsorted(points, targets), 1, max(1, n - 1))
        low, high = points[at - 1], points[np.minimum(at, n - 1)]
        return np.sort(np.where(np.abs(targets - low) <= np.abs(high - targets), low, high))
    near, spent, place = np.searchsorted(points, targets), 0, -1
    for i, t in enumerate(targets.tolist()):
        place = min(max(int(near[i]), place + 1), n - m + i)
        spent += (int(points[place]) - t) ** 2
    reach = isqrt(spent) + 1
    first = np.maximum(np.searchsorted(points, targets - reach), np.arange(m))
    last = np.minimum(np.searchsorted(points, targets + reach, side="right"), n - m + 1 + np.arange(m))
    best, low, back = np.zeros(1), -1, []  # best[k]: least cost with the target before at place low + k
    for i in range(m):
        a, z = int(first[i]), int(last[i])
        least = np.minimum.accumulate(best)
        new = np.concatenate(([True], best[1:] < least[:-1]))
        where = np.maximum.accumulate(np.where(new, np.arange(len(best)), 0))
        at = np.minimum(np.arange(a, z) - 1 - low, len(best) - 1)  # places before each candidate
        cost = np.where(at >= 0, least[np.maximum(at, 0)], np.inf) + (points[a:z] - float(targets[i])) ** 2
        back.append((a, low + where[np.maximum(at, 0)]))
        best, low = cost, a
    at, chosen = low + int(best.argmin()), []
    for a, came in reversed(back):
        chosen.append(at)
        at = int(came[at - a])
    return points[chosen[::-1]]


def split_by_points(sizes: DataFrame, points: DataFrame, totals: DataFrame, key: str, order: str, size: str, point: str, total: str) -> DataFrame:
    """key, part, start_ms, end_ms: a key's total is cut into as many parts as it has sizes, at points near the times in proportion to the running sizes.

    sizes: key, order, size of each part; totals: key, total. Sizes of which the sum is 0 give one part.
    """
    whole = proportional_targets(sizes.join(totals, key), [key], [order], size, F.col(total))
    after = Window.partitionBy(key).orderBy(order)
    cuts = whole.withColumn("_more", F.lead(order).over(after)).where(F.col("_more").isNotNull() & F.col("target").isNotNull()).select(key, order, "target")
    names = {c: sizes.schema[c].dataType.simpleString() for c in (key, order)}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                n = int((rows.column("_kind").to_numpy() == 0).sum())
                v = rows.column("v").to_numpy()
                rest = rows.slice(n)
                got = boundaries(v[n:], v[:n])
                for b in rest.append_column("_at", pa.array(got, pa.int64())).select([key, "_at"]).to_batches():
                    yield b

        for begins, b in key_runs(batches, key):
            if begins:
                yield from done()
                held = []
            held.append(b)
        yield from done()

    chosen = streamed(cuts, points.select(key, point).distinct(), key, order, "target", point).mapInArrow(choose, f"`{key}` {names[key]}, _at long")
    edges = totals.join(sizes.select(key).distinct(), key, "left_semi").select(key, F.lit(0).cast("long").alias("_at")).unionByName(chosen)
    over = Window.partitionBy(key).orderBy("_at")
    return edges.join(totals, key).select(key, (F.row_number().over(over) - 1).alias("part"), F.col("_at").alias("start_ms"), F.coalesce(F.lead("_at").over(over), F.col(total)).cast("long").alias("end_ms"))


def sub_split(segments: DataFrame, points: DataFrame, key: str, most_s: float, share: float = 0.8) -> DataFrame:
    """key, start_ms, end_ms, text: segments (unique key, start_ms, end_ms, text) of more than most_s seconds, cut into parts of about share of that.

    Cuts are at the points (key, point) nearest to equal parts, each used once, or at equal parts where a segment has too
    few points; words go in proportion to the time before each cut. Parts without words go, unless all would. Shorter segments stay
    as they are. A null text has no words.
    """
    span = F.col("end_ms") - F.col("start_ms")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    long = segments.where(span > most_s * 1000).withColumn("_n", F.greatest(F.lit(2), F.ceil(span / 1000 / (most_s * share))).cast("int"))
    sized = long.select(key, "start_ms", "end_ms", "_n", F.size(words).alias("_words"))  # without the texts, which are moved once, to their cuts
    had = points.where(F.col("point").isNotNull()).groupBy(key).agg(F.count("*").alias("_p"))
    wanted = sized.join(had, key, "left").select(key, "start_ms", "end_ms", "_n", "_words", (F.coalesce("_p", F.lit(0)) >= F.col("_n") - 1).alias("_enough"), F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("i"))
    wanted = wanted.withColumn("target", F.col("start_ms") + F.floor(F.col("i") * (span / F.col("_n"))).cast("long"))
    even = wanted.where("NOT _enough").select(key, F.col("target").alias("at"), F.expr("_words * i DIV _n").cast("int").alias("word"))
    taken = nearest_unused(wanted.where("_enough").select(key, "i", "target"), points, key, "i", "target", "point")
    word = F.floor(F.col("_words") * (F.col("point") - F.col("start_ms")) / F.greatest(span, F.lit(1))).cast("int")
    near = taken.join(sized, key).select(key, F.col("point").alias("at"), word.alias("word"))
    begin = sized.select(key, F.col("start_ms").alias("at"), F.lit(0).alias("word"))
    cuts = begin.unionByName(even).unionByName(near).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_cuts"))  # of one segment
    ends = F.transform("_cuts", lambda c, i: F.struct(c["at"].alias("start_ms"), F.coalesce(F.get("_cuts", i + 1)["at"], F.col("end_ms")).alias("end_ms"), F.array_join(F.slice("_w", c["word"] + 1, F.greatest(F.lit(0), F.coalesce(F.get("_cuts", i + 1)["word"], F.size("_w")) - c["word"])), " ").alias("text")))
    parts = long.select(key, "start_ms", "end_ms", "text").join(cuts, key).withColumn("_w", words).withColumn("_parts", F.filter(ends, lambda p: p["text"] != "")).withColumn("_one", F.array(F.struct("start_ms", "end_ms", F.col("text").alias("text"))))
    cut = parts.select(key, F.inline(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.col("_one"))))
    return segments.where(~(span > most_s * 1000)).select(key, "start_ms", "end_ms", "text").unionByName(cut)


# Sounds that are near each other, and the costs of a step, in tenths.
SOUNDS = (("aeiou", 5), ("szchf", 5), ("ptckbdg", 5), ("nm", 3), ("lr", 4))
SKIP_HEARD, SKIP_TARGET, OTHER = 5, 15, 10


def sound_cost(a: str, b: str) -> int:
    return 0 if a == b else next((c for chars, c in SOUNDS if a in chars and b in chars), OTHER)


class Warp:
    """Least-cost alignment of two strings, row by row over vectors of the band, exact in whole tenths.

    A row follows from the one before: the best of a match and of skipping a heard character, then a running minimum spreads
    skips of target characters. Every STEP-th row is kept; the way back computes the rows between two of them again, so
    memory goes with the band times the root of the length. The band is doubled until leaving it would cost more than what was found.
    """

    def __init__(self, heard: str, target: str) -> None:
        self.heard, self.target, self.costs = heard, target, {}
        self.step = max(1, isqrt(len(heard)))

    def against(self, c: str) -> np.ndarray:
        if c not in self.costs:
            of = {t: sound_cost(c, t) for t in set(self.target)}
            self.costs[c] = np.array([of[t] for t in self.target], np.int32)
        return self.costs[c]

    def row(self, above: np.ndarray, i: int, low: int, width: int) -> np.ndarray:
        """Costs of row i (1 ..) at columns i + low + 0 .. width - 1 from those of row i - 1; columns outside the target are far."""
        far, n = self.far, len(self.target)
        j = np.arange(i + low, i + low + width)
        inside = (j >= 0) & (j <= n)
        match = np.full(width, far, np.int64)
        some = inside & (j >= 1)
        match[some] = above[some] + self.against(self.heard[i - 1])[j[some] - 1]
        up = np.append(above[1:], far) + SKIP_HEARD
        best = np.where(inside, np.minimum(match, up), far)
        best = np.minimum.accumulate(best - SKIP_TARGET * j) + SKIP_TARGET * j
        return np.where(inside, np.minimum(best, far), far)

    def pairs(self) -> list[tuple[int, int]]:
        """(target place, heard place) of aligned characters; ties to the match, then to skipping a heard one."""
        n, m = len(self.heard), len(self.target)
        if not n or not m:
            return []
        self.far = 4 * (SKIP_HEARD * n + SKIP_TARGET * m)
        gap, band = m - n, 64
        while True:
            low, high = min(0, gap) - band, max(0, gap) + band
            width = high - low + 1
            j = np.arange(low, high + 1)
            row = np.where((j >= 0) & (j <= m), j * SKIP_TARGET, self.far).astype(np.int64)
            kept = [row]
            for i in range(1, n + 1):
                row = self.row(row, i, low, width)
                if i % self.step == 0:
                    kept.append(row)
            cost = int(row[m - n - low])
            out = min(SKIP_TARGET * (high + 1) + SKIP_HEARD * (high + 1 - gap), SKIP_HEARD * (1 - low) + SKIP_TARGET * (gap - low + 1))
            if cost < out or (low <= -n and high >= m):
                break
            band *= 2
        got, i, j = [], n, m
        while i and j:
            at = (i - 1) // self.step
            rows = [kept[at]]
            for r in range(at * self.step + 1, i + 1):
                rows.append(self.row(rows[-1], r, low, width))
            base = at * self.step
            while i > base and j:
                here, above = rows[i - base], rows[i - base - 1]
                c, k = int(here[j - i - low]), j - i - low
                if c == int(above[k]) + int(self.against(self.heard[i - 1])[j - 1]):
                    i, j = i - 1, j - 1
                    got.append((j, i))
                elif k + 1 < width and c == int(above[k + 1]) + SKIP_HEARD:
                    i -= 1
                else:
                    j -= 1
        return got[::-1]


def warp(heard: str, target: str) -> list[tuple[int, int]]:
    return Warp(heard, target).pairs()


@F.pandas_udf(structs(t=T.IntegerType(), s=T.IntegerType()))
def warp_udf(heard: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [{"t": t, "s": s} for t, s in warp(a, b)] for a, b in zip(heard, target, strict=True)])


def word_bounds(aligned: DataFrame, key: str, words: str, pairs: str) -> DataFrame:
    """key, word_no, word, first_char, last_char: the heard characters that each word's characters were aligned with; null if none was.

    Words and pairs are both exploded and meet by the word that a character belongs to, so the work is linear in a row's length.
    """
    lengths = aligned.select(key, F.posexplode(words).alias("word_no", "word"))
    ends = lengths.withColumn("_e", F.sum(F.length("word")).over(Window.partitionBy(key).orderBy("word_no").rowsBetween(Window.unboundedPreceding, 0)))
    chars = ends.where(F.length("word") > 0).select(key, "word_no", F.explode(F.sequence(F.col("_e") - F.length("word"), F.col("_e") - 1)).alias("t"))
    met = aligned.select(key, F.inline(pairs)).join(chars, [key, "t"]).groupBy(key, "word_no").agg(F.min("s").alias("first_char"), F.max("s").alias("last_char"))
    return lengths.join(met, [key, "word_no"], "left").select(key, "word_no", "word", "first_char", "last_char")

