"""Ball k-means on integer vectors, exact to the last unit.

A cluster is a ball: its centroid and a radius that holds its members. After a round moves the centroids, the old radius
plus the centroid's own shift bounds the new radius, without another pass. A centroid can take members of a ball only if
half its distance from the ball's centroid is within that radius: these are the ball's neighbours. Members nearer to
their centroid than half the way to the nearest neighbour are the stable core and stay unseen by any other centroid; the
rest lie in annuli, and a member of the j-th annulus is compared with the j nearest neighbours alone. All bounds are
comparisons of squared integers, so ties and results are those of the plain rounds.

Vectors stay in the tasks; what the driver holds is k centroids, their sums and radii.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import batches_of, discard, stored

#: Components beyond this would make squared distances pass 64 bits at 64 components.
MOST = 1 << 27
#: Up to this the products of whole batches are exact in double precision.
EXACT = 1 << 22
ROWS = 4096


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * x.shape[1] ** 0.5 < 8 * EXACT else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


@dataclass
class Balls:
    """Centroids with each ball's neighbours: by distance, and the squared distances from its centroid."""

    centroids: np.ndarray
    near: list[np.ndarray]
    apart: list[np.ndarray]

    @classmethod
    def of(cls, centroids: np.ndarray, radius: list[int]) -> Balls:
        """radius: of each ball, a whole number no smaller than its members' distances."""
        between = squared(centroids, centroids)
        near, apart = [], []
        for i, r in enumerate(radius):
            mine = np.array([j for j in range(len(centroids)) if j != i and int(between[i, j]) <= 4 * r * r], np.int64)
            order = np.lexsort((mine, between[i, mine])) if len(mine) else mine
            near.append(mine[order])
            apart.append(between[i, mine[order]])
        return cls(centroids, near, apart)

    def assign(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties to the smaller number), squared distance, and the comparisons made, of members x of the balls held."""
        best, out, seen = np.empty(len(x), np.int64), held.copy(), len(x)
        for i in np.unique(held):
            own = np.flatnonzero(held == i)
            d = squared(x[own], self.centroids[i : i + 1])[:, 0]
            near, to = self.near[i], d.copy()
            # a neighbour farther than twice the distance is farther from the member than its own centroid; equal ones may tie
            annulus = np.searchsorted(self.apart[i], 4 * d, side="right")
            name = np.full(len(own), i)
            for depth in np.unique(annulus[annulus > 0]):
                of = np.flatnonzero(annulus == depth)
                others = near[:depth]
                far = squared(x[own[of]], self.centroids[others])
                seen += far.size
                least = far.min(1)
                first = np.where(far == least[:, None], others, len(self.centroids)).min(1)
                moved = (least < d[of]) | ((least == d[of]) & (first < i))
                to[of[moved]], name[of[moved]] = least[moved], first[moved]
            best[own], out[own] = to, name
        return out, best, seen


def nearest_plain(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(x, centroids)
    at = d.argmin(1)  # the first of equal ones
    return at, d[np.arange(len(x)), at]


def scaled(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """key and v, whole numbers, of the vectors with exactly dim components, none null, NaN or infinite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    good = (F.size(vector) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wide = F.exists("_x", lambda c: F.abs(c * scale) >= MOST)
    v = F.when(F.col("_w"), F.raise_error(F.lit(f"a component times {scale} is {MOST} or more: squared distances would pass 64 bits"))).otherwise(F.transform("_x", lambda c: F.floor(c * scale).cast("int")))
    rows = vectors.where(F.col(vector).isNotNull()).where(good).select(F.col(key).alias("vec_id"), x.alias("_x"))
    return rows.withColumn("_w", wide).select("vec_id", v.cast("array<int>").alias("v"))


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components take no part. The first centroids are
    the k vectors with the smallest SHA-256 of "seed:id" (ties by id, then components; null ids come last); with fewer
    vectors there are fewer clusters. Repeated rows each count, null ids stay, other columns are not read, an empty table
    gives no rows. A component of MOST / scale or more raises an error, as distances would not fit.

    Each round is a narrow pass that is stored in the shared folder (components are small whole numbers, which Parquet
    packs in few bits), and an aggregation with partial sums, whatever the share of one vector or cluster. Clusters left
    empty keep their centroids.
    """
    spark = vectors.sparkSession
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = stored(scaled(vectors, key, vector, dim, scale), "ball-vectors")
    first = rows.orderBy(hashed.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    kind = vectors.schema[key].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array([r.v for r in first], np.int64)
    state = f"vec_id {kind}, v array<int>, cluster int, distance long"

    def passed(rows: DataFrame, balls: Balls) -> DataFrame:
        held = spark.sparkContext.broadcast(balls)  # k centroids and k lists of at most k neighbours

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                if "cluster" in b.schema.names:
                    name, far, _ = held.value.assign(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                else:
                    name, far = nearest_plain(x, held.value.centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(name, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "v", "cluster", "distance"])

        with batches_of(spark, ROWS):
            return stored(rows.mapInArrow(assign, state), "ball-state")

    balls = Balls(now, [], [])
    for _ in range(rounds):
        before, rows = rows, passed(rows, balls)
        discard(before)
        sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dim)]
        moved = now.copy()
        radius = [0] * len(now)
        for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("r"), *sums).collect():  # k rows at most
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
            shift = sum((int(a) - int(b)) ** 2 for a, b in zip(now[r.cluster], moved[r.cluster], strict=True))
            radius[r.cluster] = isqrt(r.r) + 1 + isqrt(shift) + 1
        now = moved
        balls = Balls.of(now, radius)
    before, rows = rows, passed(rows, balls)
    discard(before)
    return _described(rows, now, key)


def _described(rows: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    of = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    whole = sum(r.cluster_inertia for r in of)
    told = [(r.cluster, r.cluster_inertia, whole, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in of]
    each = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_kmeans(vectors: DataFrame) -> DataFrame:
    """Forty clusters after five rounds, as cluster says; odd cases are in its docstring."""
    return cluster(vectors)


def op12_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Plain rounds over all pairs of vectors and centroids."""
    steps = []
    far = "list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(dim=dim)
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := CAST({far} AS BIGINT), c := cid)) AS m FROM v CROSS JOIN c{r} c GROUP BY rid)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT a.m.c AS cid, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid) CROSS JOIN (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY ALL),
m{r} AS (SELECT cid, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cid),
c{r + 1} AS MATERIALIZED (SELECT cid, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cid))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, x) - 1 AS cid, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, vec_id, x FROM v ORDER BY h NULLS LAST, vec_id, x LIMIT {k})),
{', '.join(steps)},
f AS (SELECT v.vec_id, a.m.c AS cid, a.m.d AS d FROM a{rounds} a JOIN v USING (rid))
SELECT vec_id, CAST(f.cid AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.cid) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.cid = f.cid"""
