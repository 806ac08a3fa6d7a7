"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

Words (ASCII lower case) are hashed; a hash that at least MIN_DOCS training texts hold has an embedding (of more than
MAX_ROWS the most frequent ones), all others share row 0. Filters of the widths in WIDTHS run over the whole text, the
largest response of each is kept (max pooling over time), and a logistic layer on the pooled responses gives a logit.

Every labelled text is learned from. Words are counted over all of them; the first embedding dimension starts at the
word's log odds, smoothed towards the share of all texts. Training starts with a bounded draw, which only gives the point to start from;
then each round trains shards of all texts by Adagrad where they lie and averages what they learned. Averages are sums
of whole numbers, so they don't depend on the order in which tasks end.

Thresholds are calibrated by language on all labelled texts: beside the model, one network for each of FOLDS parts of the texts
is counted and trained without that part and gives its logits. The logit that separates best is found for every predicted
language and is mapped to score 0.3. A text's language is the likeliest by its words (naive Bayes on the counts of all
texts), so it comes from the text alone.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.llm.common import crc_mod, discard, small_batches, stored
from lexmill.llm.langid import LangModel
from lexmill.llm.licenses import words_of

WIDTHS = (1, 2, 3)
DIM, FILTERS, MIN_DOCS, MAX_ROWS = 8, 12, 3, 50_000
#: Bounds of the draw that training starts from: texts per label, characters of a text.
PER_LABEL, MAX_CHARS = 1500, 20_000
#: Rounds over all texts, texts of a shard, texts of a step, passes over the draw.
ROUNDS, SHARD, BATCH, EPOCHS = 1, 1024, 48, 6
#: Parts of the texts, which their first characters tell; texts of the usual share that a word's odds are smoothed with.
FOLDS, FOLD_CHARS, PRIOR = 4, 500, 16
CUT = 0.3
#: Toxic texts at which a language's own cut and the common one count alike.
TRUST = 8
CHUNK = 1 << 15
#: Languages with a class of their own; all others are one class, OTHERS.
CLASSES, OTHERS = 63, "other languages"
#: Units of a logit in the counts that cuts are found from, and of what shards learn.
LOGIT_STEPS, UNIT = 256, float(1 << 24)


class WordRows(dict):
    """Embedding row of a word, by its hash; starts anew when full, so memory is bounded."""

    def __init__(self, rows: dict[int, int], most: int = 1 << 17) -> None:
        super().__init__()
        self.rows, self.most = rows, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = row = self.rows.get(zlib.crc32(word), 0)
        return row

    def of(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@dataclass
class WordLangs:
    """Language of a text by its words: naive Bayes over the embedding rows."""

    names: list[str]
    table: np.ndarray  # by embedding row and language, log share of the word among the language's; row 0 is 0

    def of(self, rows: np.ndarray) -> str:
        """The likeliest language; "" for a text without known words."""
        if not self.names or not rows.any():
            return ""
        total = np.zeros(len(self.names))
        for at in range(0, len(rows), CHUNK):
            total += self.table[rows[at : at + CHUNK]].sum(0, dtype=np.float64)
        return self.names[int(total.argmax())]


def word_odds(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """By embedding row, the start of its first dimension. n0, n1: texts of each label that hold a word; all0, all1: texts of each label."""
    share = (all1 + 0.5) / (all0 + all1 + 1)
    odds = np.log((n1 + PRIOR * share) / (n0 + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return np.concatenate(([0], np.clip(odds, -4, 4) / 2))


@dataclass
class Net:
    """What is trained, and Adagrad's sums of squares."""

    params: list[np.ndarray]  # embeddings, filters by width, biases by width, the layer and its bias
    past: list[np.ndarray]

    @classmethod
    def start(cls, odds: np.ndarray, rng: np.random.Generator) -> Net:
        emb = rng.normal(0, 0.1, (len(odds), DIM)).astype(np.float32)
        emb[:, 0] = odds
        emb[0] = 0
        filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[::DIM] = np.abs(f[::DIM])
        params = [emb, *filters, *(np.zeros(FILTERS, np.float32) for _ in WIDTHS), np.full(FILTERS * len(WIDTHS), 0.1, np.float32), np.zeros(1, np.float32)]
        return cls(params, [np.full_like(p, 1e-2) for p in params])

    def copy(self) -> Net:
        return Net([p.copy() for p in self.params], [s.copy() for s in self.past])

    def windows(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Rows of the words at which each filter of width k responds most, (filters, width)."""
        w, emb, f = WIDTHS[k], self.params[0], self.params[1 + k]
        rows = np.concatenate((rows if len(rows) else np.zeros(1, np.int32), np.zeros(w - 1, np.int32)))
        best, place = np.full(FILTERS, -np.inf), np.zeros(FILTERS, np.int64)
        for at in range(0, len(rows) - w + 1, CHUNK):
            x = emb[rows[at : at + CHUNK + w - 1]]
            n = len(x) - w + 1
            r = sum(x[j : n + j] @ f[j * DIM : (j + 1) * DIM] for j in range(w))
            arg = r.argmax(0)
            top = r[arg, np.arange(FILTERS)]
            place = np.where(top > best, arg + at, place)
            best = np.maximum(best, top)
        return rows[place[:, None] + np.arange(w)]

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """One step of Adagrad on texts of embedding rows; returns the embeddings that it moved."""
        emb, filters = self.params[0], self.params[1 : 1 + len(WIDTHS)]
        biases, (out, bias) = self.params[1 + len(WIDTHS) : -2], self.params[-2:]
        where = [np.stack([self.windows(t, k) for t in texts]) for k in range(len(WIDTHS))]  # text, filter, place
        taken = [emb[at] for at in where]
        h = np.hstack([np.einsum("bfwd,wdf->bf", x, f.reshape(w, DIM, FILTERS)) + b for x, w, f, b in zip(taken, WIDTHS, filters, biases, strict=True)])
        act = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ out + bias, -30, 30)))
        g = ((p - y) * (1 if weight is None else weight) / len(texts)).astype(np.float32)
        gh = g[:, None] * out * (h > 0)
        parts = [gh[:, k * FILTERS : (k + 1) * FILTERS] for k in range(len(WIDTHS))]
        grads = [np.einsum("bfwd,bf->wdf", x, part).reshape(-1, FILTERS) for x, part in zip(taken, parts, strict=True)]
        grads += [*(part.sum(0) for part in parts), act.T @ g + 1e-3 * out, np.array([g.sum()])]
        pushed = [np.einsum("bf,wdf->bfwd", part, f.reshape(w, DIM, FILTERS)).reshape(-1, DIM) for part, w, f in zip(parts, WIDTHS, filters, strict=True)]
        unique, inverse = np.unique(np.concatenate([at.ravel() for at in where]), return_inverse=True)
        ge = np.zeros((len(unique), DIM), np.float32)
        np.add.at(ge, inverse.ravel(), np.concatenate(pushed))
        ge[unique == 0] = 0
        self.past[0][unique] += ge * ge
        emb[unique] -= 0.05 * ge / np.sqrt(self.past[0][unique])
        for q, s, d in zip(self.params[1:], self.past[1:], grads, strict=True):
            s += d * d
            q -= (0.1 * d / np.sqrt(s)).astype(np.float32)
        return unique[ge.any(1)]

    def model(self, rows: dict[int, int], lang: LangModel | WordLangs) -> ToxModel:
        emb, filters = self.params[0], self.params[1 : 1 + len(WIDTHS)]
        tables = [[emb @ f[j * DIM : (j + 1) * DIM] for j in range(w)] for w, f in zip(WIDTHS, filters, strict=True)]
        return ToxModel(rows, tables, self.params[1 + len(WIDTHS) : -2], self.params[-2], float(self.params[-1][0]), {"": 0.0}, lang)


@dataclass
class ToxModel:
    rows: dict[int, int]
    tables: list[list[np.ndarray]]  # per width and place in the filter: response of each embedding row
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    cuts: dict[str, float]  # logit that is mapped to CUT, by language; "" for all others
    lang: LangModel | WordLangs

    def logits(self, texts: list[bytes | None], cache: WordRows) -> np.ndarray:
        return self.responses(map(cache.of, texts))

    def responses(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """Logits of texts of embedding rows."""
        got = []
        edge = max(WIDTHS) - 1
        for rows in texts:
            rows = np.concatenate((rows, np.zeros(edge, np.int32)))
            pooled = []
            for w, tables, b in zip(WIDTHS, self.tables, self.biases, strict=True):
                best = tables[0][0] + sum(x[0] for x in tables[1:])  # unknown words only
                for at in range(0, len(rows) - edge, CHUNK):
                    part = rows[at : at + CHUNK + w - 1]
                    n = len(part) - w + 1
                    # places where all words are unknown respond alike, as best does
                    known = part != 0
                    some = known[:n].copy()
                    for j in range(1, w):
                        some |= known[j : n + j]
                    i = np.flatnonzero(some)
                    if len(i):
                        r = tables[0][part[i]]
                        for j in range(1, w):
                            r = r + tables[j][part[i + j]]
                        best = np.maximum(best, r.max(0))
                pooled.append(np.maximum(best + b, 0))
            got.append(np.concatenate(pooled) @ self.out + self.bias)
        return np.array(got, np.float64)

    def scores(self, texts: list[bytes | None], cache: WordRows) -> np.ndarray:
        rows = [cache.of(t) for t in texts]
        langs = [self.lang.of(r) for r in rows] if isinstance(self.lang, WordLangs) else self.lang.predict([t.decode() if t is not None else None for t in texts])[0]
        cut = np.array([self.cuts.get(x, self.cuts[""]) for x in langs])
        z = self.responses(rows) - cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def start_training(texts: list[np.ndarray], y: np.ndarray, odds: np.ndarray, rng: np.random.Generator, epochs: int, batch: int) -> Net:
    """A network trained on texts of embedding rows that are at hand."""
    net, order = Net.start(odds, rng), np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            net.step([texts[i] for i in mine], y[mine])
    return net


def train(texts: list[bytes], y: np.ndarray, lang: LangModel, rate: float, *, epochs: int = EPOCHS, batch: int = BATCH, seed: int = 7) -> ToxModel:
    """Fit on texts at hand with labels y (0 or 1), a quarter held back for the cuts. rate: share of label 1 among all labelled rows, for calibration."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.25
    seen: list[Counter[int]] = [Counter(), Counter()]
    for t, label, back in zip(texts, y, held, strict=True):
        if not back:
            seen[label].update({zlib.crc32(w) for w in set(words_of(t))})
    kept = sorted((h for h in seen[0].keys() | seen[1].keys() if seen[0][h] + seen[1][h] >= MIN_DOCS), key=lambda h: (-seen[0][h] - seen[1][h], h))[:MAX_ROWS]
    n0, n1 = (np.array([seen[v][h] for h in kept], np.float64) for v in (0, 1))
    odds = word_odds(n0, n1, int((~held).sum() - y[~held].sum()), int(y[~held].sum()))
    rows = {h: i + 1 for i, h in enumerate(kept)}
    cache = WordRows(rows)
    use = np.flatnonzero(~held)
    model = start_training([cache.of(texts[i]) for i in use], y[use], odds, rng, epochs, batch).model(rows, lang)
    back = np.flatnonzero(held)
    if len(back):
        z = model.logits([texts[i] for i in back], cache)
        langs = np.array(lang.predict([texts[i].decode() for i in back])[0])
        weight = np.where(y[back] == 1, rate / max(1e-9, y[back].mean()), (1 - rate) / max(1e-9, 1 - y[back].mean()))
        model.cuts = language_cuts(z, y[back], weight, langs, np.ones(len(back)))
    return model


def language_cuts(z: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """The common cut and each language's; n: the texts that a row stands for."""
    cuts = {"": best_cut(z, y, weight, 0.0)}
    for name in sorted(set(langs) - {""}):
        of = langs == name
        own = best_cut(z[of], y[of], weight[of], cuts[""])
        toxic = (n * y)[of].sum()
        cuts[str(name)] = cuts[""] + toxic / (toxic + TRUST) * (own - cuts[""])  # few texts say little about a language: towards the common cut
    return cuts


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray, otherwise: float) -> float:
    """The logit with the best weighted F1, midway to the next lower one."""
    if not y.any() or y.all():
        return otherwise
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    k = int(f1.argmax())
    return float(z[k] if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def labelled_texts(docs: DataFrame, labels: DataFrame, learn, per_label: int, max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most per_label (text, label) of each label, and the number of labelled documents of each label.

    Only labels of documents with a text count, so others can't use up the draw. Documents are drawn by a hash of the id;
    those of more than max_chars come last, and of them the first max_chars. A document labelled twice counts with its
    largest label, an id with several texts with the smallest of the shortest kind. What is joined are ids and lengths; what is sorted are a
    task's first per_label ids; what is collected has 2 * per_label * max_chars characters at most.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = docs.where(F.length("text") >= 1).select("doc_id", "text", (F.length("text") > max_chars).alias("_long"))
    there = known.join(texts.groupBy("doc_id").agg(F.min("_long").alias("_long")), "doc_id").select("doc_id", "y", "_long", F.xxhash64(F.lit(5), "doc_id").alias("_h"))
    counts = dict(there.groupBy("y").count().collect())
    picked = [(r.doc_id, r.y) for v in sorted(counts) for r in there.where(F.col("y") == v).orderBy("_long", "_h", "doc_id").limit(per_label).collect()]
    if not picked:
        return [], counts
    ids = docs.sparkSession.createDataFrame(picked, known.schema)
    drawn = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("_long", F.substring("text", 1, max_chars).alias("t"))).alias("r"))
    return [(r.t, r.y) for r in drawn.select("doc_id", "y", "r.t").orderBy("doc_id").collect()], counts


def labelled_words(docs: DataFrame, labels: DataFrame, learn: Column, fold_chars: int = FOLD_CHARS) -> DataFrame:
    """shard, y, lang, fold and the hashed words of every labelled text, whole, in a fixed order within a shard.

    Labels count as in labelled_texts, and of an id with several texts each is a text. Shards are dealt by a hash of the id.
    Texts become hashes where they are read, those whose id is in a bitmap of the labelled ids; only these are shuffled, once, with
    the labels, which come before their texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    known = labels.where(learn).select(key.alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    amount = known.count()
    shards, places = max(1, amount // SHARD), 1 << min(26, max(15, (8 * amount).bit_length()))
    h = F.xxhash64(F.lit(5), "doc_id")
    place = F.pmod(h, F.lit(places))
    maps = known.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    bits = np.zeros((places // 32768 + 2, 4096), np.uint8)  # 8 MB at most; bucket 0 is not used
    for r in maps:
        bits[r.b] = np.frombuffer(r.m, np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.length("text") >= 1).where(learn).where(F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", h.alias("h"), F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("at"), lang.alias("lang"), (F.crc32(F.substring("text", 1, fold_chars)) % FOLDS).cast("int").alias("fold"), "text")
    names = ["doc_id", "h", "lang", "fold", "words"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, lang string, fold int, words binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            at = b.column("at").to_numpy()
            b = b.filter(pa.array(shared.value[b.column("b").to_numpy(), at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            words = [np.fromiter(map(cache.__getitem__, w), "<u4", len(w)).tobytes() for w in map(words_of, b.column("text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(words, pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = y = None
        for b in batches:
            got = []
            for i, (doc, label, words) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "words")), strict=True)):
                if words is None:
                    now, y = doc, label
                elif doc == now:
                    got.append((i, y))
            if got:
                at, ys = zip(*got, strict=True)
                b = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(ys, pa.int32()), *(b.column(c) for c in names[2:])], ["shard", "y", *names[2:]])

    texts = rows.mapInArrow(hashed, schema).withColumn("y", F.lit(None).cast("int"))
    both = texts.unionByName(known.withColumn("h", h), allowMissingColumns=True).withColumn("shard", F.pmod("h", F.lit(shards)))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "h", "doc_id", F.col("words").asc_nulls_first())
    return stored(dealt.mapInArrow(meet, "shard long, y int, lang string, fold int, words binary"), "toxicity-words")


class WordHashes(dict):
    """Hash of a word; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


class HashRows:
    """Embedding rows of stored hashes."""

    def __init__(self, rows: dict[int, int]) -> None:
        self.hashes = np.array(sorted(rows), np.uint32)
        self.rows = np.array([0, *(rows[int(h)] for h in self.hashes)], np.int32)

    def of(self, words: bytes) -> np.ndarray:
        h = np.frombuffer(words, "<u4")
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rows[at + 1], 0)


def count_words(texts: DataFrame, classes: list[str], number: np.ndarray) -> tuple[dict[int, int], list[np.ndarray], WordLangs]:
    """Words that at least MIN_DOCS of the texts hold: their rows, their odds without each fold and with all, and their shares among each class of languages.

    number: texts by fold and label.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list[np.ndarray]] = {}
            for *key, words in zip(*(b.column(c).to_pylist() for c in ("y", "fold", "class", "words")), strict=True):
                groups.setdefault(tuple(key), []).append(np.unique(np.frombuffer(words, "<u4")))
            for key, each in groups.items():
                w, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), *(pa.array([k] * len(w), pa.int32()) for k in key), pa.array(n.astype(np.int64))], ["w", "y", "fold", "class", "n"])

    ids = F.coalesce(*(F.when(F.col("lang") == name, F.lit(i)) for i, name in enumerate(classes)), F.when(F.col("lang").isNotNull(), F.lit(len(classes)))) if classes else F.lit(None)
    found = texts.select("y", "fold", ids.cast("int").alias("class"), "words").mapInArrow(counted, "w long, y int, fold int, class int, n long")
    names = [*classes, OTHERS] if classes else []
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    columns = [amount((F.col("y") == v) & (F.col("fold") == k)).alias(f"y{v}_{k}") for v in (0, 1) for k in range(FOLDS)] + [amount(F.col("class") == i).alias(f"c{i}") for i in range(len(names))]
    counts = stored(found.groupBy("w").agg(F.sum("n").alias("texts"), *columns).where(F.col("texts") >= MIN_DOCS), "toxicity-counts")
    least, so_far = MIN_DOCS, 0
    for t, n in sorted(counts.groupBy("texts").count().collect(), reverse=True):  # as many numbers as the root of the words at most
        so_far += n
        if so_far > MAX_ROWS:
            least = t + 1
            break
    got = {c: v.to_numpy() for c, v in zip(counts.columns, counts.where(F.col("texts") >= least).orderBy("w").toArrow().columns, strict=True)}
    discard(counts)
    n0, n1 = (np.stack([got[f"y{v}_{k}"] for k in range(FOLDS)] + [np.zeros_like(got["w"])]) for v in (0, 1))
    left = np.vstack((number, [0, 0]))  # the last network leaves nothing out
    odds = [word_odds(n0.sum(0) - n0[k], n1.sum(0) - n1[k], *(left.sum(0) - left[k])) for k in range(FOLDS + 1)]
    rows = {h: i + 1 for i, h in enumerate(got["w"].tolist())}
    table = np.zeros((len(got["w"]) + 1, len(names)), np.float32)
    for i in range(len(names)):
        n = got[f"c{i}"]
        table[1:, i] = np.log((n + 0.5) / (n.sum() + 0.5 * max(1, len(n)))) if n.any() else -1e3
    return rows, odds, WordLangs(names, table)


def start_networks(spark: SparkSession, texts: list[np.ndarray], y: np.ndarray, folds: np.ndarray, odds: list[np.ndarray]) -> list[Net]:
    """A network without each fold and one with all, trained on the draw, one a task."""
    shared = spark.sparkContext.broadcast((texts, y, folds, odds))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, folds, odds = shared.value
        for b in batches:
            for k in b.column("id").to_pylist():
                use = np.flatnonzero(folds != k)
                net = start_training([texts[i] for i in use], y[use], odds[k], np.random.default_rng(7), EPOCHS, BATCH)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(net)], pa.binary())], ["id", "net"])

    got = spark.range(len(odds), numPartitions=len(odds)).mapInArrow(start, "id long, net binary").orderBy("id").collect()
    shared.destroy()
    return [pickle.loads(r.net) for r in got]


def one_round(texts: DataFrame, nets: list[Net], rows: dict[int, int], weights: tuple[float, float]) -> list[Net]:
    """Every shard trains the networks, each but for its fold; embeddings become the mean over the steps that moved them, all else that over texts."""
    shared = texts.sparkSession.sparkContext.broadcast((nets, rows))  # at most MAX_ROWS embeddings a network
    names = ["net", "id", "n", *(f"d{j}" for j in range(DIM))]

    def learned(k: int, old: Net, new: Net, moves: np.ndarray, n: int) -> pa.RecordBatch:
        """What a shard learned, in whole units; ids below 0 are pieces of all that is not an embedding."""
        ids = np.flatnonzero(moves)
        rest = np.concatenate([(a - b).ravel() for a, b in zip(new.params[1:], old.params[1:], strict=True)])
        rest = np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)
        d = np.vstack((new.params[0][ids] - old.params[0][ids], rest)).astype(np.float64)
        count = np.concatenate((moves[ids], np.full(len(rest), n)))
        whole = np.rint(d * count[:, None] * UNIT).astype(np.int64)
        ids = np.concatenate((ids, -1 - np.arange(len(rest))))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (np.full(len(ids), k), ids, count, *whole.T)], names)

    def train_shard(x: list[np.ndarray], y: np.ndarray, folds: np.ndarray) -> Iterator[pa.RecordBatch]:
        weight = np.where(y == 1, weights[1], weights[0])
        for k, old in enumerate(shared.value[0]):
            new, moves, use = old.copy(), np.zeros(len(old.params[0]), np.int64), np.flatnonzero(folds != k)
            for at in range(0, len(use), BATCH):
                mine = use[at : at + BATCH]
                moves[new.step([x[i] for i in mine], y[mine], weight[mine])] += 1
            if len(use):
                yield learned(k, old, new, moves, len(use))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = HashRows(shared.value[1])
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("shard", "words", "y", "fold")), strict=True))
        for _, group in groupby(each, lambda row: row[0]):  # some SHARD texts
            x, y, folds = zip(*((of.of(words), label, fold) for _, words, label, fold in group), strict=True)
            yield from train_shard(list(x), np.array(y), np.array(folds))

    got = texts.select("shard", "words", "y", "fold").mapInArrow(shards, ", ".join(f"{c} long" for c in names)).groupBy("net", "id").agg(*(F.sum(c).alias(c) for c in names[2:])).orderBy("net", "id").toArrow()
    shared.destroy()
    net, ids, n = (got.column(c).to_numpy() for c in names[:3])
    mean = np.stack([got.column(f"d{j}").to_numpy() for j in range(DIM)], 1) / UNIT / n[:, None]
    out = [net.copy() for net in nets]
    for k, new in enumerate(out):
        moved, rest = (net == k) & (ids >= 0), mean[(net == k) & (ids < 0)][::-1].ravel()
        new.params[0][ids[moved]] += mean[moved].astype(np.float32)
        at = 0
        for p in new.params[1:] if len(rest) else ():
            p += rest[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
    return out


def calibrate(texts: DataFrame, nets: list[Net], rows: dict[int, int], lang: WordLangs) -> dict[str, float]:
    """Cuts from all texts, each by the network without its fold: what is collected are numbers of texts by language, label and logit to 1 / LOGIT_STEPS."""
    shared = texts.sparkSession.sparkContext.broadcast(([net.params for net in nets], rows, lang))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, known, lang = shared.value
        of, models = HashRows(known), [Net(p, []).model(known, lang) for p in params]
        for b in batches:
            rows = [of.of(words) for words in b.column("words").to_pylist()]
            z = [math.floor(models[k].responses([r])[0] * LOGIT_STEPS) for k, r in zip(b.column("fold").to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([lang.of(r) for r in rows], pa.string()), pa.array(z, pa.int64())], ["y", "lang", "z"])

    got = texts.select("y", "fold", "words").mapInArrow(placed, "y int, lang string, z long").groupBy("lang", "y", "z").agg(F.count("*").alias("n")).orderBy("lang", "y", "z").collect()
    shared.destroy()
    langs, y, z, n = (np.array(c) for c in zip(*got, strict=True))
    return language_cuts(z / LOGIT_STEPS, y, n.astype(np.float64), langs, n)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, *, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> ToxModel | None:
    """Fit on all labelled texts of rows where learn holds; None without both labels.

    Null labels and labels of other values, and labels of no document or of one without a text, are left out. per_label and
    max_chars bound only the draw that training starts from.
    """
    fold_chars = min(FOLD_CHARS, max_chars)
    texts = labelled_words(docs, labels, learn, fold_chars)
    number = np.zeros((FOLDS, 2), np.int64)
    for r in texts.groupBy("fold", "y").agg(F.count("*").alias("n")).collect():
        number[r.fold, r.y] = r.n
    if not number.sum(0).all():
        return None
    classes = [r.lang for r in texts.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES).collect()]
    rows, odds, lang = count_words(texts, classes, number)
    drawn, _ = labelled_texts(docs, labels, learn, per_label, max_chars)
    cache = WordRows(rows)
    folds = np.array([zlib.crc32(t[:fold_chars].encode()) % FOLDS for t, _ in drawn])
    nets = start_networks(docs.sparkSession, [cache.of(t.encode()) for t, _ in drawn], np.array([y for _, y in drawn]), folds, odds)
    both = number.sum(0)
    take = np.minimum(per_label, both) / both  # labels weigh as in the draw
    take /= (take * both).sum() / both.sum()
    for _ in range(ROUNDS):
        nets = one_round(texts, nets, rows, (take[0], take[1]))
    model = nets[-1].model(rows, lang)
    model.cuts = calibrate(texts, nets[:-1], rows, lang)
    discard(texts)
    return model


def score_toxicity(docs: DataFrame, model: ToxModel | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) for every row; the text is the only input.

    Null and empty texts score like a text of unknown words; without a model every score is 0. Repeated rows score alike,
    null keys stay, and an empty table gives no rows. Whole texts are scored in chunks of CHUNK words, whatever their length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if model is None:
        return rows.select(F.col("_key").alias(key), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # at most MAX_ROWS embeddings

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordRows(shared.value.rows)
        for b in batches:
            s = shared.value.scores(b.column("_text").cast(pa.binary()).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(s, pa.float64())], ["_key", "score"])

    return rows.mapInArrow(score, f"_key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("_key", key)


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 remainder by 4 is not 2."""
    model = fit_toxicity(docs, labels, crc_mod("doc_id", 4) != 2)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
