"""Approximate maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are cut into subspaces with 16 centres each, so a code has four bits. The loss weighs the part of the
residual that is parallel to the vector ETA times as much as the rest, as that part changes large inner
products. Codes are chosen by coordinate descent under this loss, and centres are the weighted least-squares
solution. The quantiser is fitted on a bounded sample (SAMPLE_ROWS); every row is indexed.

Rows and queries are searched in one job. The index holds chunks of SCAN_ROWS rows, dealt to parts that one task can keep
in memory; queries are packed into blocks, and every part gets every block. A task takes up its part's chunks first and then
streams the blocks past them: each chunk's codes are scanned against per-query tables (two codes share a byte and a table of
256 sums), each query's RERANK best of a chunk are reranked by exact inner products in double precision and merged with the
best so far, and k rows a query leave the task. Nothing but the quantiser's sample passes through the driver. Parts grow
with the table up to PART_BYTES, so that queries are sent as few times as memory allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.llm.common import small_batches, stored

CENTRES, WIDTH, SAMPLE_ROWS, ROUNDS, THRESHOLD = 16, 2, 4096, 6, 0.2
#: Rows scanned at once and how many of them are reranked; queries of a block and of a step; least rows of a part.
SCAN_ROWS, RERANK, QUERY_BLOCK, QUERY_STEP, PART_LEAST = 4096, 160, 1024, 64, 4096
#: Most bytes of the vectors of a chunk, of a block of queries, and of a part, which bound a task's memory whatever the vectors' length.
CHUNK_BYTES, BLOCK_BYTES, PART_BYTES = 16 << 20, 4 << 20, 128 << 20


@dataclass
class Quantiser:
    dim: int
    books: np.ndarray  # subspaces x centres x width
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        s = len(self.books)
        padded = np.zeros((len(x), s * WIDTH))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), s, WIDTH)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes, rows x subspaces, by coordinate descent under the anisotropic loss."""
        parts = self.split(x)
        units = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        n, s = parts.shape[:2]
        codes = np.empty((n, s), np.uint8)
        parallel = np.zeros(n)  # sum over subspaces of <residual, unit>
        for j in range(s):
            d = ((parts[:, j, None] - self.books[j]) ** 2).sum(2)
            codes[:, j] = d.argmin(1)
            parallel += ((parts[:, j] - self.books[j][codes[:, j]]) * units[:, j]).sum(1)
        for _ in range(passes):
            for j in range(s):
                r = parts[:, j, None] - self.books[j]
                mine = (r * units[:, j, None]).sum(2)
                rest = parallel - mine[np.arange(n), codes[:, j]]
                loss = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + mine) ** 2
                codes[:, j] = loss.argmin(1)
                parallel = rest + mine[np.arange(n), codes[:, j]]
        return codes

    def improve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Set each centre to the least-squares solution for its rows, one subspace after another."""
        parts = self.split(x)
        units = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        s = len(self.books)
        each = np.stack([((parts[:, j] - self.books[j][codes[:, j]]) * units[:, j]).sum(1) for j in range(s)], 1)
        for j in range(s):
            rest = each.sum(1) - each[:, j]
            for c in range(CENTRES):
                of = codes[:, j] == c
                if of.any():
                    u, p = units[of, j], parts[of, j]
                    a = of.sum() * np.eye(WIDTH) + (self.eta - 1) * u.T @ u
                    b = p.sum(0) + (self.eta - 1) * ((rest[of] + (u * p).sum(1))[:, None] * u).sum(0)
                    self.books[j, c] = np.linalg.solve(a, b)
            each[:, j] = ((parts[:, j] - self.books[j][codes[:, j]]) * units[:, j]).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each pair of subspaces the 256 sums of its two codes' products with each query: pairs x queries x 256."""
        t = np.einsum("qsw,scw->sqc", self.split(q), self.books)
        if len(t) % 2:
            t = np.concatenate((t, np.zeros_like(t[:1])))
        return (t[1::2, :, :, None] + t[0::2, :, None, :]).reshape(len(t) // 2, len(q), 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack((codes, np.zeros((len(codes), 1), np.uint8)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def fit(x: np.ndarray, seed: int = 3) -> Quantiser:
    """Fit on the rows of x. The weight of the parallel part follows from THRESHOLD, the share of a query's norm from which products count."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    s = ceil(dim / WIDTH)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    q = Quantiser(dim, np.zeros((s, CENTRES, WIDTH)), eta)
    parts = q.split(x)
    for j in range(s):
        q.books[j] = parts[rng.integers(0, len(x), CENTRES), j]
    for _ in range(ROUNDS):
        q.improve(x, q.encode(x, 1))
    return q


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector of the rows that take part: not null, of one dimension, all components finite, not all zero."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("vec_id"), v.alias("embedding"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share a vec_id the one with the smallest vector; vectors move only for ids that are repeated."""
    again = stored(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if not again.count():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows, so many at a time."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Best:
    """Each query's k best rows so far: ids and exact products, best first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.own, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, tables: np.ndarray, codes: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rerank: int) -> None:
        """Approximate products of all rows by the tables, exact ones of each query's best."""
        codes = np.ascontiguousarray(codes.T)
        depth = min(len(ids), rerank)
        for at in range(0, len(self.own), QUERY_STEP):
            of = slice(at, at + QUERY_STEP)
            q = self.queries[of]
            s = np.zeros((len(q), len(ids)), np.float32)
            for j in range(len(codes)):
                s += np.take(tables[j][of], codes[j], axis=1)
            top = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if depth < len(ids) else np.broadcast_to(np.arange(depth), s.shape)
            exact = (vectors[top] * q[:, None, :]).sum(2)
            exact[ids[top] == self.own[of, None]] = -np.inf
            score, names = np.concatenate((self.score[of], exact), 1), np.concatenate((self.ids[of], ids[top]), 1)
            order = np.argsort(names, axis=1)
            score, names = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
            order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            self.score[of], self.ids[of] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)

    def rows(self) -> pa.RecordBatch:
        real = self.score > -np.inf
        asked = np.repeat(self.own, real.sum(1))
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(self.ids[real]), pa.array(self.score[real])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product other than its own, ties to the smaller id.

    Null, zero and non-finite vectors take no part, nor do rows without an id. Products are of vectors of one length, so each
    length is a search by itself. Of rows that share an id the one with the smallest vector of that length counts, among rows and among
    queries. Of rows with equal vectors the k + 1 with the smallest ids are scanned: no other can be among the k nearest, so
    a hot vector costs no more. rerank: how many of SCAN_ROWS rows have their exact products taken. Other columns are not
    read; empty tables give an empty result.
    """
    small_batches(vectors.sparkSession)
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()  # a table has few lengths
    found = [_nearest_of(one_per_id(rows.where(F.size("embedding") == s.d)), one_per_id(asked.where(F.size("embedding") == s.d)), s.d, s["count"], k, rerank) for s in sizes]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found or [empty])


def _nearest_of(rows: DataFrame, asked: DataFrame, dim: int, size: int, k: int, rerank: int) -> DataFrame:
    """nearest for usable rows and queries of dim components."""
    spark = rows.sparkSession
    drawn = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)  # ids first: tasks send no more vectors than are drawn
    picked = rows.join(F.broadcast(drawn), "vec_id", "left_semi")
    sample = np.array([r.embedding for r in picked.orderBy("vec_id").collect()], np.float64)
    quantiser = fit(sample)
    tie = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.withColumn("_n", tie).where(F.col("_n") <= k + 1).drop("_n")
    fits = lambda held, most: max(1, min(most, held // (8 * dim)))  # noqa: E731 - vectors of so many bytes
    parts = max(1, ceil(size / fits(PART_BYTES, size)), min(ceil(size / PART_LEAST), 4 * spark.sparkContext.defaultParallelism))
    shape = "ids binary, vectors binary, codes binary"

    def pack(batches: Iterator[pa.RecordBatch], most: int, coded: bool) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, most):
            x = np.asarray(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dim)
            codes = np.ascontiguousarray(packed(quantiser.encode(x)).T).tobytes() if coded else None
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (t.column("vec_id").to_numpy().astype(np.int64).tobytes(), x.tobytes(), codes)], ["ids", "vectors", "codes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for of, ids, vectors, codes in zip(*(b.column(c).to_pylist() for c in ("part", "ids", "vectors", "codes")), strict=True):
                if of != part:
                    part, held = of, []
                names, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                if codes is not None:
                    held.append((np.frombuffer(codes, np.uint8).reshape(-1, len(names)).T, names, x))
                    continue
                tables, best = quantiser.tables(x), Best(names, x, k)
                for chunk in held:
                    best.scan(tables, *chunk, rerank)
                yield best.rows()

    index = kept.repartition(parts).mapInArrow(lambda b: pack(b, fits(CHUNK_BYTES, SCAN_ROWS), True), shape)
    index = stored(index.withColumn("part", F.spark_partition_id()), "ann-index")
    blocks = stored(asked.mapInArrow(lambda b: pack(b, fits(BLOCK_BYTES, QUERY_BLOCK), False), shape), "ann-queries")
    sent = index.unionByName(blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    # a part's chunks come before the blocks, which have no codes
    dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("codes").isNull())
    found = dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(vectors: DataFrame) -> DataFrame:
    """The 20 nearest rows of each row whose id is divisible by 20."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
