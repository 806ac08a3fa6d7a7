"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows, word n-grams (64-bit hashes) columns. The product of the matrix with its transpose holds the
overlaps; it is formed only where it can reach the bound that follows from the sets' sizes:

1. Documents with equal sets are one row (the smallest id stands for them).
2. A row's n-grams are ordered, those that many documents share last. Two sets that reach the threshold share an
   n-gram among the first n - ceil(t n) + 1 of both, so only these prefixes are multiplied, a block of columns a task.
3. In a first product each row meets only the hub of its column (of the sets of like size that with fewest n-grams of its
   own, so that of near copies the original is met); overlap counts are accumulated and pairs that can't reach the bound
   with them go. The components of the links found hold nearly all near copies.
4. In a second product rows of one column meet where their components differ. A pair's overlap is bounded there and then
   by the product over all columns at once, folded to parity bits: every n-gram toggles one bit of its document's bitmap,
   so bitmaps differ in no more bits than sets differ in n-grams, and the overlap is at most (|A| + |B| - differing bits) / 2.
   Pairs for which that is below the bound that their sizes give are dropped before any row is made for them.
5. What is left of either product is verified: a hub's row is multiplied with the rows of its partners, and exact overlap
   counts decide. No link between different components is lost, and links within a component can't change it, so
   components are exact.

A column that very many rows share is split: its hub in the first product comes from an aggregation, and in the second
its rows are dealt to blocks that meet pairwise, each in a task of its own.

The order of n-grams is free to choose (any one order gives exact results), so the frequencies it uses need no
exact counts: they are the sums of the counts that reach OFTEN within pieces of the corpus, over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.llm.common import batches_of, discard, lookup_skewed, small_batches, stored
from lexmill.llm.components import connected_components

#: Frequencies: n-grams of a piece, least count within it, and how many n-grams at most have a place at the end of the order.
PIECE, OFTEN, RANKED = 2_000_000, 3, 400_000
#: Up to so many documents to verify, their ids are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 400_000
#: Bytes of a bitmap: a quarter of the set's size, as a power of two between these bounds.
BITMAP_LEAST, BITMAP_MOST = 16, 256
#: Rows of a column from which on it is split; partners of a hub that one task verifies.
SPLIT, PARTNERS = 1 << 18, 128
#: Postings of a task of the first product, some 20 MB, and most tasks.
POSTINGS, MOST_PARTS = 750_000, 1 << 17
#: Rows of a cell from which on it is multiplied alone; pairs at once, pairs held for a batch, bitmaps compared at once.
LARGE, PAIRS_AT_ONCE, PAIRS_HELD, BITMAPS_AT_ONCE = 512, 500_000, 1_000_000, 1 << 15


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte, a random 64-bit number (letters of either case alike) and whether it is white space; powers of an odd base and their inverses."""
    number = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)
    number[65:91] = number[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    number[space] = 0
    base = 0x9E3779B97F4A7C15
    power = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK - 1, b, np.uint64))), dtype=np.uint64)
    return number, space, power(base), power(pow(base, -1, 1 << 64))


#: Bytes hashed at once.
BLOCK = 1 << 15
NUMBER, SPACE, POWER, INVERSE = _byte_tables()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters in lower case, as differences of one running sum over the bytes.

    Texts are hashed in blocks that end at white space; words of BLOCK bytes or more are hashed alone.
    """
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        part = raw[at : at + BLOCK]
        space = SPACE[part]
        size = len(part)
        if size == BLOCK:
            gaps = np.flatnonzero(space)
            if not len(gaps):
                end = at + BLOCK
                while end < len(raw) and not (more := SPACE[raw[end : end + BLOCK]]).any():
                    end += BLOCK
                end = min(len(raw), end + int(more.argmax())) if end < len(raw) else len(raw)
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end].lower())], np.uint64))
                at = end
                continue
            size = int(gaps[-1]) + 1
            part, space = part[:size], space[:size]
        sums = np.cumsum(NUMBER[part] * POWER[:size], dtype=np.uint64)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        first, last = edge[0::2], edge[1::2]
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        h = (sums[last - 1] - before) * INVERSE[first]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        at += size
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the whole text, ASCII letters in lower case; with fewer words, of the whole sequence."""
    h = word_hashes(text or b"")  # bytes: only ASCII letters change, and only ASCII white space parts words
    if not len(h):
        return np.zeros(0, np.int64)
    k = min(k, len(h))
    acc = h[: len(h) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - k + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((acc ^ (acc >> np.uint64(31))).view(np.int64))


def prefix_length(n, num: int, den: int):
    return n + num * n // -den + 1


def least_overlap(a, b, num: int, den: int):
    """Smallest overlap of sets of sizes a and b whose Jaccard similarity is num / den or more."""
    return -(num * (a + b) // -(num + den))


def frequent(docs: DataFrame, k: int, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted by hash, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def often() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= OFTEN]), pa.array(c[c >= OFTEN])], ["h", "c"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append(shingles(t, k))
                n += len(held[-1])
                if n >= PIECE:
                    yield often()
                    held, n = [], 0
        if held:
            yield often()

    found = stored(docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    band = F.floor(F.log2("c") * 8)  # a cut at a band's edge, so that no more than the rows wanted leave the executors
    least, n = None, 0
    for b, size in found.groupBy(band.alias("b")).count().orderBy(F.desc("b")).collect():
        n += size
        if n > ranked:
            break
        least = b
    top = found.where(band >= least if least is not None else F.lit(False)).toArrow()
    discard(found)
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def bitmap(h: np.ndarray) -> bytes:
    """Parity bits of the set: each n-gram toggles the bit of its lowest hash bits, so a bitmap folds to any shorter one by exclusive or."""
    size = BITMAP_LEAST
    while size < BITMAP_MOST and size * 4 < len(h):
        size *= 2
    odd = np.bincount(h & (size * 8 - 1), minlength=size * 8) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """The bitmaps folded to size bytes, as rows of 64-bit words."""
    lengths = np.array([len(b) for b in bits])
    out = np.empty((len(bits), size // 8), np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        words = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1, size // 8)
        out[at] = np.bitwise_xor.reduce(words, axis=1)
    return out


def apart(bits: list[bytes], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of r and c differ, the longer folded to the shorter: at most as many as n-grams."""
    out = np.zeros(len(r), np.int64)
    if not len(r):
        return out
    lengths = np.fromiter(map(len, bits), np.int64, len(bits))
    short = np.minimum(lengths[r], lengths[c])
    for size in np.unique(short):
        of = np.flatnonzero(short == size)
        for at in range(0, len(of), BITMAPS_AT_ONCE):
            part = of[at : at + BITMAPS_AT_ONCE]
            used, flat = np.unique(np.concatenate((r[part], c[part])), return_inverse=True)
            words = folded([bits[u] for u in used], int(size))
            out[part] = np.bitwise_count(words[flat[: len(part)]] ^ words[flat[len(part) :]]).sum(1)
    return out


class Often:
    """The frequent n-grams with their counts, and a table of the upper bits that any of them has."""

    BITS = 20

    def __init__(self, known: np.ndarray, counts: np.ndarray) -> None:
        self.known, self.counts = known, counts
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.upper(known)] = True

    def upper(self, h: np.ndarray) -> np.ndarray:
        return h.view(np.uint64) >> np.uint64(64 - self.BITS)

    def count(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.known):
            maybe = np.flatnonzero(self.seen[self.upper(h)])
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == h[maybe], self.counts[at], 0)
        return out


def ordered_prefix(h: np.ndarray, often: Often, num: int, den: int) -> tuple[np.ndarray, int]:
    """The set's prefix in order (by count, then by hash), and how many of the set's n-grams are not frequent."""
    c = often.count(h)
    rare, size = h[c == 0], prefix_length(len(h), num, den)  # sorted by hash as h is
    if len(rare) >= size:
        return rare[:size], len(rare)
    h, c = h[c > 0], c[c > 0]
    return np.concatenate((rare, h[np.lexsort((h, c))]))[:size], len(rare)


def set_rows(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[int]]:
    """Per row: doc_id, n, the number of n-grams that are not frequent, a 128-bit digest of the set, the prefix in order (64-bit integers), the bitmap. And the n-grams of more than SPLIT documents."""
    spark = docs.sparkSession
    known, counts = frequent(docs, k)
    often = spark.sparkContext.broadcast((known, counts))  # RANKED n-grams at most

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Often(*often.value)
        for b in batches:
            n, rare, sig, prefix, bits = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingles(t, k)
                n.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                first, own = ordered_prefix(h, table, num, den) if len(h) else (h, 0)
                prefix.append(first.tobytes())
                rare.append(own)
                bits.append(bitmap(h))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "rare", "sig", "prefix", "bits"])

    rows = stored(docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n long, rare long, sig binary, prefix binary, bits binary"), "sets")
    often.destroy()
    return rows, known[counts > SPLIT].tolist()


def columns(rows: DataFrame) -> DataFrame:
    """The incidence matrix of the prefixes: h, node, n, rare, pos."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = b.column("prefix").to_pylist()
            size = np.array([len(p) // 8 for p in prefixes])
            if size.sum():
                h = np.frombuffer(b"".join(prefixes), np.int64)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                each = lambda c, kind: pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), size).astype(kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(h), each("node", np.int64), each("n", np.int32), each("rare", np.int32), pa.array(pos.astype(np.int32))], ["h", "node", "n", "rare", "pos"])

    return rows.select("node", "n", "rare", "prefix").mapInArrow(explode, "h long, node long, n int, rare int, pos int")


def in_lists(batches: Iterator[pa.RecordBatch], names: list[str], most: int = 1 << 20) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Batches sorted by h, cut where h changes. A longer list comes in parts: (rows, first rows go on from before, last rows go on)."""
    held: dict[str, np.ndarray] | None = None
    on = False
    for b in batches:
        new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        if not b.num_rows:
            continue
        held = new if held is None else {c: np.concatenate((held[c], new[c])) for c in names}
        h = held["h"]
        cut = int(np.searchsorted(h, h[-1]))
        if len(h) < 1 << 16 and len(h) < most:
            continue
        if cut:
            yield {c: v[:cut] for c, v in held.items()}, on, False
            held, on = {c: v[cut:] for c, v in held.items()}, False
        elif len(h) >= most:
            yield held, on, True
            held, on = {c: v[:0] for c, v in held.items()}, True
    if held is not None and len(held["h"]):
        yield held, on, False


def split_hubs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """What hubs returns, for columns of any number of rows: rows of like size are a band, and a band's hub comes from an aggregation."""
    band = F.floor(F.log(F.col("n").cast("double")) / log(den / num)) if den > num else F.col("n").cast("long")
    banded = postings.withColumn("cell", F.struct("h", band.alias("band")))
    hub = F.min_by(F.struct(F.col("node").alias("hub"), F.col("n").cast("long").alias("hub_n")), F.struct("rare", "node")).alias("best")
    best = stored(banded.groupBy("cell").agg(hub, F.count("*").alias("size")), "hot-hubs")
    return lookup_skewed(banded, best, "cell", "size").select("h", "node", "n", "pos", "best.hub", "best.hub_n")


def hubs(postings: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """h, node, n, pos of columns with two rows or more, and the hub with its size: of the column's rows of like size that with fewest n-grams of its own; in so many parts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, on, more in in_lists(batches, ["h", "node", "n", "rare", "pos"]):
            h, n = x["h"], x["n"].astype(np.int64)
            first = np.concatenate(([True], h[1:] != h[:-1]))
            start = np.flatnonzero(first)
            length = np.diff(np.append(start, len(h)))
            hub = np.repeat(start, length)
            end = hub + np.repeat(length, length)
            multi = np.repeat(length, length) > 1
            if on:
                multi |= h == h[0]
            if more:
                multi |= h == h[-1]
            while True:  # rows too large for the first of their part of the column begin the next part
                far = np.flatnonzero(n * num > n[hub] * den)
                if not len(far):
                    break
                lead = far[np.concatenate(([True], end[far[1:]] != end[far[:-1]]))]
                hub[far] = lead[np.searchsorted(lead, far, side="right") - 1]
            order = np.lexsort((x["node"], x["rare"], hub))
            part = hub[order]
            best = order[np.concatenate(([True], part[1:] != part[:-1]))]
            hub = np.repeat(best, np.unique(part, return_counts=True)[1])[np.argsort(order, kind="stable")]
            yield pa.RecordBatch.from_arrays([pa.array(v[multi]) for v in (h, x["node"], x["n"], x["pos"], x["node"][hub], n[hub])], ["h", "node", "n", "pos", "hub", "hub_n"])

    return postings.repartition(parts, "h").sortWithinPartitions("h", "n", "node").mapInArrow(find, "h long, node long, n int, pos int, hub long, hub_n long")


def cross_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of rows of different components that share a column within the places their sizes allow and whose bitmaps leave the threshold within reach.

    postings: h, x, y, side, node, n, pos, comp, bits. Of a column that is split, x and y name the two blocks that meet, and
    side is the row's own; where x = y, rows of that one block meet. Sets that overlap in alpha n-grams share one within the
    first n - alpha + 1 of both.
    """
    names = ["h", "x", "y", "side", "node", "n", "pos", "comp", "bits"]

    def candidates(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows that meet in a cell, some PAIRS_AT_ONCE at a time; cells whose rows share a component have none."""
        h, x, y, comp, n = t["h"], t["x"], t["y"], t["comp"], t["n"]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        length = np.diff(np.append(start, len(h)))
        mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        large = length > LARGE
        row = np.flatnonzero(np.repeat(mixed & ~large, length))
        partners = np.repeat(start + length, length)[row] - row - 1
        total = np.cumsum(partners)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            count = partners[at:to]
            r = np.repeat(row[at:to], count)
            yield r, r + 1 + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            at = to
        for s in np.flatnonzero(mixed & large):
            first, end = int(start[s]), int(start[s] + length[s])
            step = max(1, PAIRS_AT_ONCE // (end - first))
            for at in range(first, end, step):
                # rows are sorted by size, so partners of at..to end where sizes get too large
                to = min(at + step, end)
                stop = first + int(np.searchsorted(n[first:end].astype(np.int64) * num, int(n[to - 1]) * den, side="right"))
                i, j = np.nonzero(np.arange(at, stop)[None, :] > np.arange(at, to)[:, None])
                yield i + at, j + at

    def met(t: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the candidates: different components, sizes and places that allow the threshold, bitmaps near enough."""
        node, comp, side = t["node"], t["comp"], t["side"]
        ok = (comp[r] != comp[c]) & (node[r] != node[c]) & ((t["x"][r] == t["y"][r]) | (side[r] != side[c]))
        r, c = r[ok], c[ok]
        n, pos = t["n"].astype(np.int64), t["pos"].astype(np.int64)
        ok = n[c] * num <= n[r] * den
        r, c = r[ok], c[ok]
        alpha = least_overlap(n[r], n[c], num, den)
        ok = (pos[r] <= n[r] - alpha) & (pos[c] <= n[c] - alpha)
        r, c, alpha = r[ok], c[ok], alpha[ok]
        near = (n[r] + n[c] - apart(t["bits"], r, c)) // 2 >= alpha
        r, c = r[near], c[near]
        return np.minimum(node[r], node[c]), np.maximum(node[r], node[c])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate([p[c] for p in held]) for c in range(2))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

        for t in in_cells(batches, names):
            for r, c in candidates(t):
                found = met(t, r, c)
                if not len(found[0]):
                    continue
                held.append(found)
                size += len(found[0])
                if size >= PAIRS_HELD:
                    yield batch()
                    held, size = [], 0
        if size:
            yield batch()

    dealt = postings.select(names).repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "n", "node")
    return dealt.mapInArrow(emit, "a long, b long").distinct()


def in_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of whole cells (equal h, x, y) of batches sorted by these. A cell has 2 * SPLIT rows or so at most."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        h, x, y = new["h"], new["x"], new["y"]
        if held and (h[0], x[0], y[0]) != last:
            yield {c: np.concatenate([p[c] for p in held]) for c in names}
            held = []
        ends = np.flatnonzero((h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        cut = int(ends[-1]) if len(ends) else 0
        if cut:
            held.append({c: v[:cut] for c, v in new.items()})
            yield {c: np.concatenate([p[c] for p in held]) for c in names}
            held = []
        held.append({c: v[cut:] for c, v in new.items()})
        last = (h[-1], x[-1], y[-1])
    if held:
        yield {c: np.concatenate([p[c] for p in held]) for c in names}


def cells(placed: DataFrame, hot: list[int]) -> DataFrame:
    """placed with x, y, side: 0 for all rows of a column, or of a hot one a row's block with every other block of it."""
    whole = [F.lit(0).alias(c) for c in ("x", "y", "side")]
    if not hot:
        return placed.select("*", *whole)
    spark = placed.sparkSession
    names = F.broadcast(spark.createDataFrame([(h,) for h in hot], "h long"))  # RANKED at most
    rows = placed.join(names, "h", "left_semi")
    blocks = F.broadcast(rows.groupBy("h").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = rows.join(blocks, "h").withColumn("side", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = each.select(*placed.columns, F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "side")
    return placed.join(names, "h", "left_anti").select("*", *whole).unionByName(split)


def above_bound(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose shared prefix columns and the longer of the two rests together can reach the least overlap."""
    size = lambda c: f"({c} - CAST(ceil({num} * {c} / {den}D - 1e-9) AS LONG) + 1)"
    return pairs.where(f"shared + greatest(na - {size('na')}, nb - {size('nb')}) >= CAST(ceil({num} * (na + nb) / {num + den}D - 1e-9) AS LONG)")


def within_reach(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps leave the threshold within reach."""
    small = lambda c: rows.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            bits = x.column("bits_a").to_pylist() + x.column("bits_b").to_pylist()
            each = np.arange(x.num_rows)
            near = pa.array((na + nb - apart(bits, each, each + x.num_rows)) // 2 >= least_overlap(na, nb, num, den), pa.bool_())
            yield x.select(["a", "b"]).filter(near)

    of_hub = small("a").join(pairs.groupBy("a").agg(F.count("*").alias("partners")), "a")  # a hub may have any share of the pairs
    return lookup_skewed(pairs, of_hub, "a", "partners").join(small("b"), "b").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, by exact overlap counts; stored. A task has PARTNERS of a hub's partners at most or so."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size")).where(F.col("size") > PARTNERS).withColumn("parts", F.ceil(F.col("size") / PARTNERS))
    parted = lookup_skewed(pairs, sizes, "a", "size").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    members = parted.select(F.col("a").alias("g"), "part", F.lit(1).alias("kind"), F.col("b").alias("node"))
    wanted = stored(members.unionByName(parted.select(F.col("a").alias("g"), "part", F.lit(0).alias("kind"), F.col("a").alias("node")).distinct()), "wanted")
    nodes = wanted.select(F.col("node").alias("doc_id")).distinct()
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    texts = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    rows = wanted.join(texts.withColumnRenamed("doc_id", "node"), "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, hub = None, []
        for b in batches:
            a_out, b_out = [], []
            for g, kind, node, t in zip(*(b.column(c).to_pylist() for c in ("g", "kind", "node")), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                mine = shingles(t, k)
                if kind == 0:
                    hub = [*hub, mine] if of == g else [mine]
                    of = g
                    continue
                for h in hub:
                    if min(len(h), len(mine)) * den < max(len(h), len(mine)) * num:
                        continue
                    both = len(np.intersect1d(h, mine, assume_unique=True))
                    if both * den >= num * (len(h) + len(mine) - both):
                        a_out.append(g)
                        b_out.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    links = stored(rows.repartition("g", "part").sortWithinPartitions("g", "part", "kind", "node").select("g", "kind", "node", "text").mapInArrow(check, "a long, b long"), "links")
    discard(wanted)
    return links


def near_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id long, text string; other columns are not read).

    Documents whose sets of k-word shingles have a Jaccard similarity of num / den or more are linked; component_id is the
    smallest id reachable. Null and empty texts have empty sets and no links. Rows that share an id are one document, linked
    by any of its texts. Rows without an id have their n_shingles and a null component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, hot = set_rows(docs, k, num, den)
    live = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = live.withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("doc_id"))).where("r = 1")
    distinct = stored(first.select(F.col("doc_id").alias("node"), "n", "rare", "prefix", "bits"), "distinct-sets")
    size = live.groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1")
    copies = lookup_skewed(live.select("doc_id", "sig"), size, "sig", "copies").where("node < doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    postings = columns(distinct)
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    parts = max(1, min(MOST_PARTS, -(-total // POSTINGS)))
    if hot:
        names = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in hot], "h long"))
        found = hubs(postings.join(names, "h", "left_anti"), num, den, parts).unionByName(split_hubs(postings.join(names, "h", "left_semi"), num, den))
    else:
        found = hubs(postings, num, den, parts)
    with batches_of(docs.sparkSession, 16_384):  # numbers only
        shared = stored(found, "columns")
    met = shared.where("hub <> node").groupBy(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("na"), F.col("n").cast("long").alias("nb")).agg(F.count("*").alias("shared"))
    hub_pairs = above_bound(met, num, den).where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b").distinct()  # a pair that meets in other columns too may be missed here, not below
    hub_pairs = stored(hub_pairs, "hub-pairs")
    near = stored(within_reach(hub_pairs, distinct, num, den), "near")
    links = verified(near, docs, k, num, den)
    found = connected_components(links)
    nodes = distinct.select("node", "bits").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "bits")
    placed = shared.select("h", "node", "n", "pos").join(nodes, "node")
    with batches_of(docs.sparkSession, 4096):  # numbers and bitmaps
        pairs = stored(cross_pairs(cells(placed, hot), num, den), "pairs")
    discard(shared)
    more = verified(pairs, docs, k, num, den)
    stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    all_found = connected_components(stars.unionByName(more).unionByName(copies))
    discard(distinct, hub_pairs, near, links, found, pairs, more)
    ids = rows.select("doc_id", F.col("n").alias("n_shingles"))
    return ids.join(all_found, ids.doc_id == all_found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """Four-word shingles and 85 / 100 over every document; odd cases are as near_components states. Very long texts are shingled whole, in blocks of bytes."""
    return near_components(docs)


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """docs without those that are not their component's smallest id; of rows that share an id one stays. Rows without an id stay."""
    others = stored(components.where("component_id < doc_id").select("doc_id").distinct(), "others")
    if others.count() <= BROADCAST_IDS:
        others = F.broadcast(others)
    left = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    again = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.count():
        return left
    order = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    first = left.join(again, "doc_id", "left_semi").withColumn("_r", one).where("_r = 1").select(docs.columns)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(first)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * i >= 85 * (na + nb - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m AS component_id FROM s JOIN c ON c.a = s.doc_id"""
