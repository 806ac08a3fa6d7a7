"""Collocations by PCY and DHP passes.

Pass n counts the phrases of n words exactly and, in the same scan, drops the phrases of n + 1 words into hash buckets. Before
pass n + 1 the buckets that hold enough become a bitmap, and so do the frequent phrases of n words (Apriori): a phrase of
n + 1 words is counted only if its bucket's bit is set and those of both its parts of n words are. Both bitmaps are
broadcast, of at most BITS_MOST bits each, and let through too much at worst, never too little; counts are exact, by the
phrases' own words.

A task works on the bytes of whole Arrow batches: places of words come from one scan over a byte table, hashes of words from
differences of one running sum, and hashes of phrases from those of their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.common import discard, lookup_skewed, small_batches, stored

LEAST, SIZES, TOP, COVER_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000
#: Bits of the hash that name a bucket: a bucket for every BYTES_A_BUCKET bytes of text, within these bounds.
BITS_LEAST, BITS_MOST, BYTES_A_BUCKET = 16, 26, 32
#: Buckets that travel together; bytes scanned at once.
CHUNK_BITS, SLICE = 12, 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
LOWER = bytes(_LOW.tolist())
_BASE = 0x9E3779B97F4A7C15
_NUMBER = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))
_NUMBER = _NUMBER[_LOW]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its parts without the last and without the first word."""
    return mixed(prefix * np.uint64(_BASE) + (suffix ^ (suffix >> np.uint64(31))) * np.uint64(0x94D049BB133111EB))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    run = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)  # noqa: E731
    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def slices(raw: np.ndarray, off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about most bytes that end where a text or a piece ends; a longer piece is one stretch."""
    at, whole = int(off[0]), int(off[-1])
    while at < whole:
        end = min(at + most, whole)
        if end < whole:
            k = int(np.searchsorted(off, end, side="right")) - 1
            cut = int(off[k])
            if cut <= at:  # within one text
                text_end, found = int(off[k + 1]), np.flatnonzero(_KIND[raw[at:end]] == 2)
                cut = at + int(found[-1]) + 1 if len(found) else end
                while not len(found) and cut < text_end:
                    found = np.flatnonzero(_KIND[raw[cut : min(cut + most, text_end)]] == 2)
                    cut = cut + int(found[0]) + 1 if len(found) else min(cut + most, text_end)
            end = cut
        yield at, end
        at = end


class Stretch:
    """Places and hashes of the words of a stretch of bytes, and of their phrases."""

    def __init__(self, raw: np.ndarray, breaks: np.ndarray, names: np.ndarray, salts: np.ndarray, power: tuple[np.ndarray, np.ndarray]) -> None:
        """breaks: starts of texts in raw, the first is 0; names: number of each text's language, whose salts go into the hashes."""
        kind = _KIND[raw]
        word = kind == 0
        edge = np.zeros(len(raw), bool)
        edge[breaks[breaks < len(raw)]] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | edge[1:]
        self.first = np.flatnonzero(starts)
        stop = np.append(np.flatnonzero(~word | edge), len(raw))
        self.last = stop[np.searchsorted(stop, self.first, side="right")]
        text = np.searchsorted(breaks, self.first, side="right") - 1
        self.lang = names[text]
        self.piece = np.cumsum(kind == 2)[self.first] + text
        sums = np.cumsum(_NUMBER[raw] * power[0][: len(raw)], dtype=np.uint64)
        before = np.where(self.first > 0, sums[self.first - 1], np.uint64(0))
        h = (sums[self.last - 1] - before) * power[1][self.first]
        self.raw = raw
        self.phrases = [mixed(mixed(h + (self.last - self.first).astype(np.uint64)) ^ salts[self.lang])]

    def of(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on (also across pieces: see within)."""
        while len(self.phrases) < n:
            h = self.phrases[-1]
            self.phrases.append(joined(h[:-1], h[1:]))
        return self.phrases[n - 1]

    def within(self, n: int) -> np.ndarray:
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def texts(self, at: np.ndarray, n: int) -> list[bytes]:
        """The phrases of n words from the words at on, in lower case, one space between words."""
        low = self.raw.tobytes().translate(LOWER)
        start, end = self.first[at], self.last[at + n - 1]
        out = [low[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]
        for j in range(n - 1):
            gap = self.first[at + j + 1] - self.last[at + j]
            for i in np.flatnonzero((gap != 1) | (self.raw[self.last[at + j]] != 32)).tolist():
                out[i] = b" ".join(out[i].split())
        return out


def bit(h: np.ndarray, bits: int, which: int) -> np.ndarray:
    """One of two independent bucket numbers of a hash."""
    return ((h if which == 0 else h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64)


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def chunk_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Chunks of the counts that hold any: places and counts, or all counts where that is shorter."""
    for c, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
        some = np.flatnonzero(part)
        if len(some):
            yield c, b"p" + some.astype("<u2").tobytes() + part[some].tobytes() if 3 * len(some) < len(part) else b"a" + part.tobytes()


def add_chunk(held: np.ndarray, payload: bytes) -> None:
    """Counts are added up to 255: more is no matter, as LEAST is less."""
    if payload[:1] == b"a":
        held[:] = np.minimum(held.astype(np.uint16) + np.frombuffer(payload, np.uint8, offset=1), 255)
    else:
        n = (len(payload) - 1) // 3
        at = np.frombuffer(payload, "<u2", n, 1)
        held[at] = np.minimum(held[at].astype(np.uint16) + np.frombuffer(payload, np.uint8, n, 1 + 2 * n), 255)


def bitmap_of(chunks: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bits of the buckets whose counts add up to least. Each task adds the chunks that it gets as they come; what the driver gets are 2 ** bits bits."""
    spark = chunks.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), strict=True):
                add_chunk(held.setdefault(c, np.zeros(1 << CHUNK_BITS, np.uint8)), payload)
        rows = [(c, np.packbits(v >= least, bitorder="little").tobytes()) for c, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "payload"])

    out = np.zeros(1 << max(0, bits - 3), np.uint8).reshape(-1, 1 << (CHUNK_BITS - 3))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in chunks.repartition(parts, "chunk").mapInArrow(add, "chunk long, payload binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(r.payload, np.uint8)
    return out.ravel()


def marked(found: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes h of the frequent phrases."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            counts[bit(b.column("h").to_numpy().view(np.uint64), bits, 1)] = 255
        yield from chunk_batches(counts)

    return bitmap_of(found.select("h").mapInArrow(mark, "chunk long, payload binary"), bits, 255)


def chunk_batches(counts: np.ndarray, rows: int = 512) -> Iterator[pa.RecordBatch]:
    got: list[tuple[int, bytes]] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int64()), pa.array([r[1] for r in got], pa.binary())], ["chunk", "payload"])  # noqa: E731
    for r in chunk_rows(counts):
        got.append(r)
        if len(got) == rows:
            yield batch()
            got = []
    if got:
        yield batch()


def count_pass(docs: DataFrame, n: int, bits: int, buckets: np.ndarray | None, parts: np.ndarray | None, last: bool) -> DataFrame:
    """Rows of one scan: counts of phrases of n words of each stretch (lang, gram, h, cnt), and chunks of the buckets of n + 1 words.

    A phrase passes if its bucket's bit and those of its two parts are set. gram '' has the number of all words (n = 1).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((buckets, parts))  # 2 ** bits bits each at most
    schema = "lang string, gram string, h long, cnt long, chunk long, payload binary"
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_bits, part_bits = shared.value
        power = powers(SLICE)
        counts = np.zeros(1 if last else 1 << bits, np.uint8)
        for b in batches:
            text = b.column("text").cast(pa.large_binary()).fill_null(b"")
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if not len(text) or off[0] == off[-1]:
                continue
            raw = np.frombuffer(text.buffers()[2], np.uint8)
            known = b.column("lang").dictionary_encode()
            langs = known.dictionary.to_pylist()
            salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
            name = known.indices.to_numpy()
            for start, end in slices(raw, off, SLICE):
                if end - start > len(power[0]):
                    power = powers(end - start)
                t0, t1 = (int(np.searchsorted(off, x, side="right")) - 1 for x in (start, end - 1))
                s = Stretch(raw[start:end], np.maximum(off[t0 : t1 + 1] - start, 0), name[t0 : t1 + 1], salts, power)
                if len(s.first) < n:
                    continue
                h, passes = s.of(n), s.within(n)
                if n > 1:
                    at = np.flatnonzero(passes)
                    at = at[holds(bucket_bits, bit(h[at], bits, 0))]
                    of = s.of(n - 1)
                    at = at[holds(part_bits, bit(of[at], bits, 1))]
                    at = at[holds(part_bits, bit(of[at + 1], bits, 1))]
                    passes = np.zeros(len(h), bool)
                    passes[at] = True
                else:
                    at = np.arange(len(h))
                    total = np.bincount(s.lang, minlength=len(langs))
                    yield batch(lang=pa.array(langs), gram=pa.array([""] * len(langs)), h=pa.nulls(len(langs)), cnt=pa.array(total))
                if not len(at):
                    continue
                u, where, c = np.unique(h[at], return_index=True, return_counts=True)
                where = at[where]
                yield batch(lang=known.dictionary.take(pa.array(s.lang[where])), gram=pa.array(s.texts(where, n), pa.binary()).cast(pa.string()), h=pa.array(u.view(np.int64)), cnt=pa.array(c))
                if not last:
                    both = np.flatnonzero(passes[:-1] & passes[1:] & s.within(n + 1)) if len(passes) > 1 else np.zeros(0, np.int64)
                    u, c = np.unique(bit(s.of(n + 1)[both], bits, 0), return_counts=True) if len(both) else (both, both)
                    counts[u] = np.minimum(counts[u] + np.minimum(c, 255), 255)
        if not last:
            for x in chunk_batches(counts):
                yield batch(chunk=x.column("chunk"), payload=x.column("payload"))

    return docs.mapInArrow(scan, schema)


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, sizes: int = SIZES, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, f) of all phrases of up to sizes words that occur least times, and (lang, n) with the number of all words.

    Each pass is stored in the shared folder, as its counts and its buckets are both read; chunks of buckets go once the
    bitmap is made. bits: of the bucket tables; by default they grow with the text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    if bits is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        bits = min(BITS_MOST, max(BITS_LEAST, (size // BYTES_A_BUCKET).bit_length()))
    found, total, buckets, parts = [], None, None, None
    for n in range(1, sizes + 1):
        seen = stored(count_pass(rows, n, bits, buckets, parts, n == sizes), f"phrases-{n}")
        grams = seen.where("chunk IS NULL").groupBy("lang", "gram").agg(F.sum("cnt").alias("f"), F.max("h").alias("h"))
        if n == 1:
            total = stored(grams.where("gram = ''").select("lang", F.col("f").alias("n")), "phrases-total")
        found.append(stored(grams.where((F.col("gram") != "") & (F.col("f") >= least)), f"frequent-{n}"))
        if n < sizes:
            buckets, parts = bitmap_of(seen.where("chunk IS NOT NULL").select("chunk", "payload"), bits, least), marked(found[-1], bits)
        discard(seen)
    return reduce(DataFrame.unionByName, (f.select("lang", "gram", "f") for f in found)), total


def score_of() -> Column:
    """floor(SCALE a / (l + r)), by whole numbers of 38 digits."""
    return F.expr(f"CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(18, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, sizes: int = SIZES, top: int = TOP, cover: int = COVER_PERCENT, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's top phrases of 2 to sizes words with a of least or more.

    Null and empty texts have no words; a null language is und; repeated rows all count; ids and other columns are not
    read; an empty table gives no rows. Texts are scanned whole, a stretch of pieces at a time, so memory goes with the longest piece between
    punctuation marks. Parts that very many phrases share are looked up by broadcast, and only the bounded top of each
    language and hash class meets in one task. Products are decimals of 38 digits, divided as whole numbers.
    """
    freq, total = frequent_phrases(docs, text=text, lang=lang, least=least, sizes=sizes, bits=bits)
    freq = stored(freq, "phrases-frequent")
    key = lambda g: F.concat("lang", F.lit("\n"), g)  # noqa: E731 - words hold no line break
    known = freq.select(key(F.col("gram")).alias("_k"), F.col("f").alias("_f"))
    cands = freq.withColumn("w", F.split("gram", " ")).withColumn("m", F.size("w")).where("m > 1")
    phrase = lambda i, k: F.array_join(F.slice("w", i, k), " ")  # noqa: E731

    def looked_up(rows: DataFrame, part: str, name: str) -> DataFrame:
        keyed = rows.withColumn("_k", key(F.col(part)))
        weights = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
        return lookup_skewed(keyed, known.join(weights, "_k"), "_k", "_n").withColumnRenamed("_f", name).drop("_k")

    cuts = cands.select("lang", "gram", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "gram", "a", "k", phrase(F.lit(1), F.col("k")).alias("_first"), phrase(F.col("k") + 1, F.col("m") - F.col("k")).alias("_rest"))
    half = stored(looked_up(stored(cuts, "phrase-cuts"), "_first", "l").drop("_first"), "phrase-cuts")
    cut = stored(looked_up(half, "_rest", "r").drop("_rest"), "phrase-cuts")
    lowest = cut.withColumn("score", score_of()).groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "gram", "a", "c.score", "c.l", "c.r")
    inner = cands.where("m > 2").select("lang", F.col("f").alias("_b"), "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("j"))
    inner = inner.select("lang", "_b", "w", "j", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("j") + 1)).alias("i"))
    covers = inner.select("lang", phrase(F.col("i"), F.col("j")).alias("gram"), "_b").groupBy("lang", "gram").agg(F.max("_b").alias("_b"))
    left = lowest.join(covers, ["lang", "gram"], "left").where(F.expr(f"_b IS NULL OR CAST(_b AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {cover}"))
    order = [F.desc("score"), F.desc("a"), "gram"]
    best = lambda rows, keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # noqa: E731
    first = best(left.withColumn("_s", F.pmod(F.xxhash64("gram"), F.lit(64))), ["lang", "_s"]).drop("_s", "rank")
    return best(first, ["lang"]).join(F.broadcast(total), "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(docs: DataFrame) -> DataFrame:
    """The first 2,000 phrases of each language, as collocations says; odd cases are in its docstring."""
    return collocations(docs)


def op11_sql() -> str:
    low = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = lambda n: "array_to_string(w[i : i + {}], ' ')".format(n - 1)  # noqa: E731
    sizes = " UNION ALL ".join(f"SELECT lang, {n} AS m, {gram(n)} AS gram FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)" for n in range(1, SIZES + 1))
    return rf"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array({low}, '[.,;:!?

]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, gram, count(*) AS f FROM ({sizes}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, gram, f AS a, string_split(gram, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, gram, a, k, array_to_string(w[1 : k], ' ') AS g1, array_to_string(w[k + 1 : m], ' ') AS g2 FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.gram, k.a, k.k, x.f AS l, y.f AS r, (CAST(k.a AS HUGEINT) * {SCALE}) // (x.f + y.f) AS score FROM k JOIN f x ON x.lang = k.lang AND x.gram = k.g1 JOIN f y ON y.lang = k.lang AND y.gram = k.g2),
lo AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
cv AS (SELECT lang, gram, max(a) AS b FROM (SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c))) GROUP BY ALL),
o AS (SELECT lo.* FROM lo LEFT JOIN cv USING (lang, gram) WHERE b IS NULL OR CAST(b AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {COVER_PERCENT}),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(gram)) AS rank FROM o)
SELECT lang, rank, gram AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN tot USING (lang) WHERE rank <= {TOP}"""
