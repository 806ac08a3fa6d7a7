"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised (lower case; runs of what is no letter or digit are one space). If an
item of m characters occurs with at most k edits, at least m - q + 1 - k q of its q-grams are shared, and all of them
on k + 1 neighbouring diagonals (place in the text less place in the item). Shared q-grams are counted in bands of
2 (k + 1) diagonals that overlap by half, so some band holds them all. Bands that reach the bound are verified by a banded
alignment with free ends in the text. Items too short for the budget at the usual q have a shorter one, at which the bound
is at least one. The filter loses nothing: every place that holds an item within its budget is a row or overlaps one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import small_batches

Q, RATE = 10, 0.08
#: Items are searched in blocks of so many, or of so many characters; texts in pieces of so many characters, which overlap.
ITEM_BLOCK, BLOCK_CHARS, PIECE = 10_000, 4 << 20, 1 << 20
BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower case (where that is one code point), and whether it is a letter or digit."""
    global _tables
    if _tables is None:
        low = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)
        _tables = low, np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _tables


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the text."""
    low, alnum = tables()
    cp = low[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_word = alnum[cp]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    at = np.flatnonzero(keep)
    return np.where(is_word[at], cp[at], 32).astype(np.uint32), at


def gram_hashes(s: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram, from sums of doubling length."""
    if len(s) < q:
        return np.zeros(0, np.uint64)
    power, h, n, base, done = s.astype(np.uint64), None, 1, int(_MULT), 0
    width = q
    while width:
        if width & 1:
            part = power[done : done + len(s) - q + 1]
            h = part if h is None else h * np.uint64(base) + part
            done += n
        width >>= 1
        if width:
            power = power[: len(power) - n] * np.uint64(base) + power[n:]
            base, n = base * base % (1 << 64), 2 * n
    return (h ^ (h >> np.uint64(31))) * _MULT


def band_costs(item: np.ndarray, text: np.ndarray, first: int, width: int, anchored: bool = False) -> np.ndarray:
    """Least edits to turn item into a part of text that ends at each diagonal's last place, on diagonals first .. first + width - 1.

    The part may start anywhere on the band, or if anchored on diagonal 0 alone.
    """
    d = np.arange(first, first + width)
    far = len(item) + len(text) + 1
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    if anchored:
        row = np.where(d >= 0, np.minimum(d, far), far)
    for i, c in enumerate(item):
        j = d + i  # places in the text
        inside = (j >= 0) & (j < len(text))
        same = np.full(width, True)
        same[inside] = text[j[inside]] != c
        new = np.where(inside, row + same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - d) + d
        row = np.where((j + 1 >= 0) & (j + 1 <= len(text)), new, far)
    return row


def banded(item: np.ndarray, text: np.ndarray, first: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """The least of band_costs, and where that part ends."""
    row = band_costs(item, text, first, width, anchored)
    best = int(row.argmin())
    return int(row[best]), first + best + len(item)


def inexact(item: np.ndarray, text: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of parts of text within k edits of item, from left to right and apart from each other, until any other overlaps one of them.

    The text is aligned a window at a time, so the work is linear in it. Of ends within 2 k of the first one, the best counts.
    """
    m, z = len(item), 0
    window = 4 * (m + k)
    while len(text) - z >= m - k:
        part = text[z : z + window]
        more = z + window < len(text)
        costs = band_costs(item, part, -k, max(1, len(part) - m + 2 * k + 1))  # by end, from m - k on
        found = np.flatnonzero(costs <= k)
        if not len(found):
            if not more:
                return
            z += window - m - k
            continue
        near = costs[found[0] : found[0] + 2 * k + 1]
        end = int(found[0] + near.argmin()) - k + m
        if more and found[0] + 3 * k + m >= window and end > m + k:  # a better end may lie beyond the window
            z += end - m - k
            continue
        back, length = banded(item[::-1], part[:end][::-1], -k - 1, 2 * k + 3, anchored=True)
        yield z + max(0, end - length), z + end, min(int(near.min()), back)
        z += max(1, end)


class Grams:
    """Index of the q-grams of the items of one q: hashes with items and places."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int) -> None:
        self.q = q
        grams = [gram_hashes(s, q) for _, s in items]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.grams, start = np.unique(h[order], return_index=True)
        self.start = np.append(start, len(h))
        self.item = np.concatenate([np.full(len(g), n) for (n, _), g in zip(items, grams, strict=True)])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.grams >> np.uint64(64 - BITS)] = True


class Items:
    """Index of benchmark items: q-gram hashes with their places, for each q that items need."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> None:
        self.ids, self.texts, self.budget = [], [], []
        self.short = []  # items without a q-gram are sought as they are, as whole words
        of: dict[int, list[tuple[int, np.ndarray]]] = {}
        least = []
        for key, text in items:
            s = normalised(text or "")[0]
            s = s[: len(s) - 1] if len(s) and s[-1] == 32 else s
            if not len(s):
                continue
            k, n = int(rate * len(s)), len(self.ids)
            mine = min(q, len(s) // (k + 1))  # at this q an item with k edits still shares a q-gram
            self.ids.append(key)
            self.texts.append(s)
            self.budget.append(k)
            least.append(len(s) - mine + 1 - k * mine)
            if len(s) < q:
                self.short.append(n)
            else:
                of.setdefault(mine, []).append((n, s))
        self.grams = [Grams(v, mine) for mine, v in sorted(of.items())]
        self.width = 2 * (np.array(self.budget, np.int64) + 1)
        self.bound = np.array(least, np.int64)
        self.overlap = 4 * max((len(t) for t in self.texts), default=0) + q

    def bands(self, s: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Of each item the bands of diagonals of the normalised text s that hold enough of its q-grams."""
        found: dict[int, list[tuple[int, int]]] = {}
        for g in self.grams:
            h = gram_hashes(s, g.q)
            at = np.flatnonzero(g.bitmap[h >> np.uint64(64 - BITS)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(g.grams, h[at]), len(g.grams) - 1)
            real = g.grams[k] == h[at]
            at, k = at[real], k[real]
            if not len(at):
                continue
            count = g.start[k + 1] - g.start[k]
            rep = np.repeat(np.arange(len(k)), count)
            post = g.start[k][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
            item, place = g.item[post], g.place[post]
            diagonal = at[rep] - place + (1 << 28)
            for shift in (0, 1):
                w = self.width[item]
                band = (diagonal + shift * (w // 2)) // w
                order = np.lexsort((place, band, item))
                i, b, p = item[order], band[order], place[order]
                new = np.concatenate(([True], (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
                once = np.concatenate(([True], p[1:] != p[:-1])) | new  # an item's q-gram counts once a band
                first = np.flatnonzero(new)
                shared = np.add.reduceat(once, first)
                for f in first[shared >= self.bound[i[first]]]:
                    w0 = int(self.width[i[f]])
                    low = int(b[f]) * w0 - shift * (w0 // 2) - (1 << 28)
                    found.setdefault(int(i[f]), []).append((low, low + w0 - 1))
        return found

    def find(self, s: np.ndarray, taken: dict[int, int] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each region of the normalised text s that holds an item within its budget.

        Stretches of the text that bands lead to are searched whole: first exact places, then what lies between them.
        Regions of an item don't overlap, and every place within the budget is one or overlaps one. taken: where to begin, by item.
        """
        for i, bands in self.bands(s).items():
            item, k = self.texts[i], self.budget[i]
            m, begin = len(item), (taken or {}).get(i, 0)
            for low, high in self.merged(sorted((a - k, z + m + k + 1) for a, z in bands)):
                a, z = max(0, begin, low), min(len(s), high)
                if z - a < m - k:
                    continue
                hits = [(a + p, a + p + m, 0) for p in self.places(s[a:z], item)]
                edges = [a, *(x for p, e, _ in hits for x in (p, e)), z]
                for u, v in zip(edges[::2], edges[1::2], strict=True):
                    hits += [(u + p, u + e, n) for p, e, n in inexact(item, s[u:v], k)] if k else []
                for p, e, n in sorted(hits):
                    yield i, p, e, n

    @staticmethod
    def merged(bands: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for low, high in bands:
            if out and low <= out[-1][1] + 1:
                out[-1] = out[-1][0], max(high, out[-1][1])
            else:
                out.append((low, high))
        return out

    @staticmethod
    def places(s: np.ndarray, item: np.ndarray, overlapping: bool = False) -> list[int]:
        raw, sought, found, at = s.tobytes(), item.tobytes(), [], 0
        while (at := raw.find(sought, at)) >= 0:
            if at % 4 == 0:
                found.append(at // 4)
                at += 4 if overlapping else len(sought)
            else:
                at += 1
        return found

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, characters of the item) in code points of the whole text, end exclusive."""
        if not text:
            return []
        s, at = normalised(text)
        out = set()
        for i in self.short:
            m = len(self.texts[i])
            for p in self.places(s, self.texts[i], overlapping=True):
                if (p == 0 or s[p - 1] == 32) and (p + m == len(s) or s[p + m] == 32):
                    out.add((self.ids[i], int(at[p]), int(at[p + m - 1]) + 1, 0, m))
        taken: dict[int, int] = {}
        for p in range(0, max(1, len(s)), PIECE):
            for i, a, z, edits in self.find(s[p : p + PIECE + self.overlap], {i: e - p for i, e in taken.items()}):
                if a < PIECE:  # later ones are whole in the next piece
                    out.add((self.ids[i], int(at[p + a]), int(at[p + z - 1]) + 1, edits, len(self.texts[i])))
                    taken[i] = p + z
        return sorted(out)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with a text, ITEM_BLOCK or BLOCK_CHARS characters at a time; one empty block if there are none."""
    block, held, n = [], 0, 0
    for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text)
        if len(block) == ITEM_BLOCK or held >= BLOCK_CHARS:
            yield block
            block, held, n = [], 0, n + 1
    if block or not n:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and region that holds a benchmark item within its edit budget: doc_id, item_id, start_pos, end_pos, edits, similarity.

    The budget is rate times the item's normalised length, cut to a whole number. Regions of one item in one text don't
    overlap; where places within the budget do, exact ones count first, then from left to right the best of those that end close to each
    other, ties to the first. Null and empty texts, and items without a letter or digit, have no regions; repeated items
    count once, repeated documents each; null ids stay; other columns are not read; empty tables give no rows. Items of
    fewer than q normalised characters count where they stand as whole words. Whole texts are searched in overlapping
    pieces, whatever their length. Items are held by the tasks in blocks of ITEM_BLOCK or BLOCK_CHARS characters, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(block, q, rate))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(k, *r) for k, t in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True) for r in shared.value.scan(t)]
                cols = list(zip(*found, strict=True)) if found else [()] * 6
                ids = pa.array(cols[0], b.column("_key").type)
                near = [1.0 - e / n for e, n in zip(cols[4], cols[5], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(near, pa.float64())], ["_key", "item_id", "start_pos", "end_pos", "edits", "similarity"])

        return rows.mapInArrow(scan, f"_key {kind}, item_id long, start_pos long, end_pos long, edits long, similarity double")

    return reduce(DataFrame.unionByName, map(search, item_blocks(benchmark))).withColumnRenamed("_key", key)


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every region of every document that holds a benchmark item; odd cases are as find_leaks states."""
    return find_leaks(docs, benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item within its edit budget; no join, one pass for each block of items.

    Null and empty texts stay, as do null ids and all columns; repeated rows go or stay alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = docs.schema
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block, q, rate))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.scan(t) for t in b.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
