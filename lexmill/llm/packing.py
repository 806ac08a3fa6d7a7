"""Lexical retrieval packing: windows are filled with a seed document's nearest unused documents by BM25.

Documents are tokenised once and stored. Document frequencies of token ids are counted over the whole corpus; they are
as many as the vocabulary, so they reach every task. The inverted index is sharded by content, not by file: a document's
route is made of its heaviest terms (by BM25 weight, of those that enough documents hold to fill part of a shard), documents
are range partitioned by route, and shards are runs of documents in that order. So documents that share their heavy terms
meet in a shard wherever they lie in the table, and a route that a third of all documents share is cut into as many shards as
it needs. Within a shard the first unused document seeds a window; all its terms are looked up in the shard's index, and
unused neighbours fill the window, best first, the last one cut to fit. What a shard leaves, less than a window, goes on to
the next one of its task; what the tasks leave is routed and packed again, as another level, until one shard holds it all.

Work is linear in the corpus, and memory is bounded by the shard. Every window but the last few is full: the last tokens of
the corpus form shorter sequences, of sizes that are powers of two.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import discard, small_batches, stored

WINDOW, END = 4096, 2
SHARD_TOKENS, SHARD_DOCS = 1_500_000, 2048
K1, B = 1.2, 0.75
#: Heaviest terms in a route (at most four), neighbours that are sorted at first.
ROUTE_TERMS, SORTED = 4, 24

_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_ODD = re.compile(r"[\x1c-\x1f]")
# The vocabulary's own pattern over lower-case text of these characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def little(ids: list[int]) -> bytes:
    """Little-endian 16-bit ids."""
    held = array("H", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


_MARKS = [(c, f"\0{c}\0") for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()]
_DIGITS = [(c, f"\0{c}\0") for c in "0123456789"]
_SPACES = "\t\n\v\f\r "


class Words:
    """16-bit little-endian ids of texts. Holds the vocabulary and no cache, so memory does not grow with texts."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.merge = merger(vocabulary)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.merge is None or "<|" in text:
            return little(self.whole(text))
        if _PLAIN.fullmatch(text):
            return self.plain(text)
        if _ODD.search(text):
            return little(self.whole(text))
        # what white space parts is tokenised alone, so only words of other characters need the slower way
        out, run = [], []
        for word in text.split():
            if _PLAIN.fullmatch(word):
                run.append(word)
                continue
            out += [self.plain(" ".join(run)), little(self.whole(word))]
            run = []
        return b"".join([*out, self.plain(" ".join(run))])

    def plain(self, text: str) -> bytes:
        """Ids of a text of plain characters; its parts are ended by a zero byte."""
        low = text.lower()
        if "'" in low:
            parts = _PARTS.findall(low)
            return little(self.merge("\0".join(parts) + "\0")) if parts else b""
        # without contractions the parts are runs of letters, runs of marks and single digits: ends are put by replacing
        for old, new in _MARKS:
            low = low.replace(old, new)
        low = low.replace("\0\0", "")  # between marks that stand together
        for old, new in _DIGITS:
            low = low.replace(old, new)
        for c in _SPACES:
            low = low.replace(c, "\0")
        return little(self.merge(low + "\0"))


def merger(vocabulary: str):
    """The vocabulary's byte-pair merges of parts by tiktoken, several times as fast; None if it is of another kind.

    A byte that no part holds stands for the end of a part. Ids are ranks in both, so merges come in the same order;
    tests hold the ids against those of tokenizers.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = plain + [256 + i for i in range(256 - len(plain))]  # how byte-level vocabularies write bytes
    byte = {chr(c): b for c, b in zip(shown, plain + [b for b in range(256) if b not in plain], strict=True)}
    ranks = {}
    for token, i in model["vocab"].items():
        ends = token.endswith(suffix) and token != suffix
        body = token.removesuffix(suffix) if ends else token
        if all(c in byte for c in body) and not token.startswith("<|"):
            ranks[bytes(byte[c] for c in body) + b"\0" * ends] = i
    encoding = tiktoken.Encoding("parts", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


_words: dict[str, Words] = {}


def words_for(vocabulary: str) -> Words:
    """The worker's tokeniser for the vocabulary; kept from task to task."""
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and tokens (16-bit ids of the whole text, then END) of every row, stored."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_for(vocabulary), END.to_bytes(2, "little")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words.ids(t) + end for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "tokens"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(encode, f"doc_id {docs.schema[key].dataType.simpleString()}, tokens binary"), "tokens")


def term_counts(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (place in the list), term and count, sorted by owner and term; of at most 65,536 documents."""
    owner = np.repeat(np.arange(len(tokens), dtype=np.uint32), [len(t) for t in tokens])
    key = np.sort(owner << np.uint32(16) | np.concatenate(tokens).astype(np.uint32)) if len(owner) else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint32(16)).astype(np.int32), (key[first] & np.uint32(0xFFFF)).astype(np.int32), count


def corpus_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number of documents, mean length; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            ids = [np.frombuffer(t, "<u2") for t in b.column(0).to_pylist()]
            df += np.bincount(term_counts(ids)[1], minlength=1 << 16)
            docs, total = docs + len(ids), total + sum(map(len, ids))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, total]))], ["id", "n"])

    got = tokens.select("tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    df, rest = np.zeros(1 << 16, np.int64), {-1: 0, -2: 0}
    for i, n in got:
        if i >= 0:
            df[i] = n
        else:
            rest[i] = n
    return df, rest[-1], rest[-2] / max(1, rest[-1])


def bm25(term: np.ndarray, count: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """Weights of terms that occur count times in documents of these sizes."""
    tf = count.astype(np.float32)
    return (idf[term] * tf * np.float32(K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1e-9)))).astype(np.float32)


def routes(tokens: list[np.ndarray], idf: np.ndarray, usual: np.ndarray, mean: float) -> np.ndarray:
    """Per document its ROUTE_TERMS heaviest terms of those that are usual, heaviest first, as one number."""
    owner, term, count = term_counts(tokens)
    size = np.array([len(t) for t in tokens])
    on = usual[term]
    owner, term, count = owner[on], term[on], count[on]
    weight = bm25(term, count, size[owner], idf, mean)
    route = np.zeros(len(tokens), np.int64)
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    held = np.diff(np.append(start, len(owner)))
    for _ in range(ROUTE_TERMS):
        heaviest = np.full(len(tokens), 0xFFFF, np.int64)
        if len(start):
            best = np.maximum.reduceat(weight, start)
            at = np.flatnonzero((weight == np.repeat(best, held)) & (weight > 0))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))] if len(at) else at  # of equal ones the smallest term
            heaviest[owner[at]] = term[at]
            weight[at] = 0
        route = route << 16 | heaviest
    return route


class Shard:
    """BM25 inverted index of some documents' tokens.

    Terms that at least an eighth of them hold have their weights in a dense row, the others in postings.
    """

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n = len(tokens)
        doc, term, count = term_counts(tokens)
        weight = bm25(term, count, np.array([len(t) for t in tokens])[doc] if self.n else doc, idf, mean)
        self.terms = term  # by document
        self.bounds = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.by_term = doc[order], weight[order]
        self.lists = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        held = np.diff(self.lists)
        common = np.flatnonzero(held * 8 >= max(8, self.n))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        at = self.row[term]
        self.dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """Each document's BM25 score for all terms of the seed."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64)
        terms = terms[row < 0]
        size = self.lists[terms + 1] - self.lists[terms]
        if size.sum():
            places = np.arange(size.sum()) + np.repeat(self.lists[terms] - (np.cumsum(size) - size), size)
            out += np.bincount(self.docs[places], self.by_term[places], self.n)
        return out

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """All free documents that share a term with the seed, best first, ties in order; free is read at the start."""
        score = np.where(free, self.scores(seed), 0)
        least = 0.0
        if self.n > 2 * SORTED:  # a window rarely needs more than the first few, so these are sorted alone
            least = max(0.0, -np.partition(-score, SORTED)[SORTED])
            best = np.flatnonzero(score > least)
            yield from best[np.lexsort((best, -score[best]))].tolist()
            best = np.flatnonzero((score <= least) & (score > 0))
        else:
            best = np.flatnonzero(score > 0)
        yield from best[np.lexsort((best, -score[best]))].tolist()


Piece = tuple[object, np.ndarray, int, int]  # id, all tokens, start, length


def fill(pool: list[Piece], shard: Shard) -> Iterator[list[Piece]]:
    """Windows of exactly WINDOW tokens over the pool's pieces. Returns the pieces that are left, less than a window."""
    free = np.ones(len(pool), bool)
    pool = list(pool)
    room, window, seed = WINDOW, [], 0

    def take(i: int) -> None:
        nonlocal room
        key, tokens, start, n = pool[i]
        cut = min(n, room)
        window.append((key, tokens, start, cut))
        room -= cut
        if cut == n:
            free[i] = False
        else:
            pool[i] = (key, tokens, start + cut, n - cut)

    left = sum(p[3] for p in pool)
    while left >= WINDOW:
        while not free[seed]:
            seed += 1
        take(seed)
        if room:
            for i in shard.neighbours(seed, free):
                take(i)
                if not room:
                    break
        if not room:
            yield window
            left -= WINDOW
            room, window = WINDOW, []
    # a window that was begun goes on with what is left
    return window + [p for p, f in zip(pool, free, strict=True) if f]


def powers_of_two(rest: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences of the pieces in their order, each the largest power of two that is left: no padding."""
    rest = list(rest)
    total = sum(p[3] for p in rest)
    while total:
        size = min(WINDOW, 1 << (total.bit_length() - 1))
        part, need = [], size
        while need:
            key, tokens, start, n = rest[0]
            cut = min(n, need)
            part.append((key, tokens, start, cut))
            need -= cut
            rest[0] = (key, tokens, start + cut, n - cut)
            if cut == n:
                rest.pop(0)
        yield part
        total -= size


OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", *(c.split()[0] for c in OUT.split(", "))]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def whole_windows(tokens: DataFrame) -> DataFrame:
    """The sequences that a document of WINDOW tokens or more has of its own."""
    tokens = tokens.where(F.length("tokens") >= 2 * WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = 1 << 62 | partition() << 36
        for b in batches:
            kinds = {"doc_id": b.column("doc_id").type} | dict.fromkeys(COLUMNS[1:], pa.int64())
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                for start in range(0, len(ids) // WINDOW * WINDOW, WINDOW):
                    rows.append((doc, start, WINDOW, crc(ids[start : start + WINDOW]), len(ids), sequence, 0))
                    sequence += 1
            yield batch(rows, kinds)

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, {OUT}")


PIECES = {"id": pa.int64(), "route": pa.int64(), "doc_id": None, "start": pa.int64(), "doc_tokens": pa.int64(), "tokens": pa.binary()}


def remainders(tokens: DataFrame, weights, usual: np.ndarray, mean: float) -> DataFrame:
    """id, route, doc_id, start, doc_tokens, tokens of what the own sequences leave, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = partition() << 36
        for b in batches:
            rows, ids = [], []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                start = len(raw) // 2 // WINDOW * WINDOW
                if len(raw) > 2 * start:
                    rows.append((i, doc, start, len(raw) // 2, raw[2 * start :]))
                    ids.append(np.frombuffer(rows[-1][-1], "<u2"))
                    i += 1
            route = routes(ids, weights.value, usual, mean).tolist() if rows else []
            yield batch([(r[0], w, *r[1:]) for r, w in zip(rows, route, strict=True)], PIECES | {"doc_id": b.column("doc_id").type})

    return stored(tokens.mapInArrow(run, f"id long, route long, doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start long, doc_tokens long, tokens binary"), "rest")


def packed(free: DataFrame, parts: int, level: int, weights, mean: float, last: bool) -> DataFrame:
    """One level: OUT's columns of the sequences (tokens null), and the pieces that each task leaves (sequence_id null); with last, nothing is left. Stored."""
    kind = free.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = level << 58 | partition() << 36
        pool: list[Piece] = []
        held, kinds = 0, {}

        def rows_of(window: list[Piece]) -> list[tuple]:
            nonlocal sequence
            at, rows = 0, []
            for (i, route, doc, first, n), ids, start, length in window:
                rows.append((doc, first + start, length, crc(ids[start : start + length]), n, sequence, at, None, None, None))
                at += length
            sequence += 1
            return rows

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pool, held
            rows = []
            windows = fill(pool, Shard([ids[start : start + n] for _, ids, start, n in pool], weights.value, mean))  # of a piece that was cut, what is left of it
            while True:
                try:
                    rows += rows_of(next(windows))
                except StopIteration as end:
                    pool = end.value
                    break
                if len(rows) >= 4096:
                    yield batch(rows, kinds)
                    rows = []
            held = sum(p[3] for p in pool)
            yield batch(rows, kinds)

        for b in batches:
            kinds = {"doc_id": b.column("doc_id").type} | dict.fromkeys(COLUMNS[1:], pa.int64()) | {"id": pa.int64(), "route": pa.int64(), "tokens": pa.binary()}
            for i, route, doc, start, n, raw in zip(*(b.column(c).to_pylist() for c in PIECES), strict=True):
                ids = np.frombuffer(raw, "<u2")
                pool.append(((i, route, doc, start, n), ids, 0, len(ids)))
                held += len(ids)
                if held >= SHARD_TOKENS or (len(pool) >= SHARD_DOCS and held >= 8 * WINDOW):
                    yield from flush()
        if pool:
            yield from flush()
        if last:
            for part in powers_of_two(pool):
                yield batch(rows_of(part), kinds)
        elif pool:
            yield batch([(doc, first + start, None, None, n, None, None, i, route, ids[start : start + length].tobytes()) for (i, route, doc, first, n), ids, start, length in pool], kinds)

    placed = free.repartitionByRange(parts, "route", "id").sortWithinPartitions("route", "id") if parts > 1 else free.coalesce(1).sortWithinPartitions("route", "id")
    return stored(placed.select(*PIECES).mapInArrow(run, f"doc_id {kind}, {OUT}, id long, route long, tokens binary"), "packed")


def pack(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most WINDOW tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are END alone. A document of WINDOW tokens or more gets sequences of its own; its rest is packed like
    any other. Repeated rows are packed each, rows without an id too. Columns but the key and the text are not read. An empty
    table has no pieces.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, vocabulary, key=key, text=text)
    df, n, mean = corpus_statistics(tokens)
    weights = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    free, out, level = remainders(tokens, weights, df >= min(SHARD_DOCS, n) // 8, mean), whole_windows(tokens), 0
    while True:
        pieces, left = free.agg(F.count("*"), F.coalesce(F.sum(F.length("tokens") / 2), F.lit(0.0))).first()
        if not pieces:
            break
        parts = ceil(left / SHARD_TOKENS)  # a task leaves less than a window, so levels shrink some hundredfold
        done = packed(free, parts, level, weights, mean, parts == 1)
        if not level:
            discard(free)
        out = out.unionByName(done.where("tokens IS NULL").select(*COLUMNS))
        free, level = done.where("tokens IS NOT NULL").select(*PIECES), level + 1
        if parts == 1:
            break
    return out


def op6_packing(docs: DataFrame) -> DataFrame:
    """Pieces of all documents under the vocabulary of the contract; odd cases are as pack states. Very long texts are tokenised in parts whose ends are put right, and cut into windows of their own."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
