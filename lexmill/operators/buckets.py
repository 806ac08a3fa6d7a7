"""Tables whose upserts rewrite what changes: rows are dealt to buckets by a hash of the key, and a batch rewrites the buckets it touches.

Files of bucket b as of version v lie in path/data/v=.../b=..., and path/versions lists which buckets each version wrote. A version counts once
it is listed there, in one small write after its files; before that readers see the one before. Old versions stay readable.
A batch applied again under its version changes nothing. Writers of one table must come one after another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Buckets:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int, schema) -> None:
        self.spark, self.path, self.keys, self.buckets, self.schema = spark, path.rstrip("/"), keys, buckets, schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def written(self) -> DataFrame:
        """version, b of every bucket written; none before the first version."""
        return self.spark.read.schema("version long, b int").parquet(f"{self.path}/versions")

    def _write(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        dealt = rows.select(*[c.name for c in self.schema], self.bucket().alias("b"))
        dealt.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/data/v={version}")
        self.spark.createDataFrame([(version, b) for b in touched], "version long, b int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def create(self, rows: DataFrame) -> Buckets:
        """Version 0; a table that was there is replaced."""
        self.spark.createDataFrame([], "version long, b int").write.mode("overwrite").parquet(f"{self.path}/versions")
        self._write(rows, 0, list(range(self.buckets)))
        return self

    def current(self, version: int | None = None, only: list[int] | None = None) -> dict[int, list[int]]:
        """version: buckets whose newest state, as of the version asked, it holds. As many entries as buckets at most."""
        rows = self.written() if version is None else self.written().where(F.col("version") <= version)
        rows = rows if only is None else rows.where(F.col("b").isin(only))
        out: dict[int, list[int]] = {}
        for r in rows.groupBy("b").agg(F.max("version").alias("v")).collect():
            out.setdefault(r.v, []).append(r.b)
        return out

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of a version, of these buckets alone; files of other buckets and versions are not opened."""
        names = [c.name for c in self.schema]
        out = self.spark.createDataFrame([], self.schema)
        for v, buckets in sorted(self.current(version, only).items()):
            part = self.spark.read.schema(self.spark.createDataFrame([], self.schema).withColumn("b", F.lit(0)).schema).parquet(f"{self.path}/data/v={v}")
            out = out.unionByName(part.where(F.col("b").isin(sorted(buckets))).select(*names))
        return out

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Merge a batch (read twice) into the buckets it touches, which are returned; none if that version is there already."""
        last = self.written().agg(F.max("version")).first()[0]
        version = last + 1 if version is None else version
        if version <= last:
            return []
        touched = sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())  # as many as buckets at most
        if touched:
            self._write(merge(self.read(only=touched), batch), version, touched)
        return touched
