"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.operators.durable import shared_base

#: Rows of an Arrow batch. Texts may hold a megabyte each, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in the Python workers. Plans are lazy, so the session keeps the setting; it is the same for all operators."""
    spark.conf.set(_ROWS, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows for the actions within, for rows of numbers."""
    old = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, old)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse."""
    return f"{shared_base(spark).rstrip('/')}/lexmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what stored wrote for the frames, once later states have been stored and nothing else reads them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of a column's text form, modulo divisor; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def labelled_sample(df: DataFrame, label: str, per_label: int, *, key: str = "doc_id", text: str = "text", max_chars: int = 20_000, max_labels: int = 64, max_total: int = 32_000_000, seed: int = 17) -> list[tuple[str, object]]:
    """At most per_label (text, label) pairs of every label, drawn by a hash of the key; fewer a label if there are more than max_labels.

    Bounded by max_total characters (500 a text at least), as max_chars goes down where there are many texts to draw. Texts of more than max_chars are drawn
    where a label has too few others, and of those the first max_chars. What is drawn first is a few times per_label, whatever the number of rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).collect()
    if not counts:
        return []
    per_label = max(1, min(per_label, per_label * max_labels // len(counts)))
    max_chars = max(500, min(max_chars, max_total // (per_label * len(counts))))
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 40))
    below = [(value, int(min(1.0, (3.0 * per_label + 30) / n) * (1 << 40))) for value, n in counts]
    bound = F.broadcast(df.sparkSession.createDataFrame(below, f"_y {df.schema[label].dataType.simpleString()}, _below long"))
    long = F.length(text) > max_chars
    drawn = rows.join(bound, F.col(label) == F.col("_y")).where(h < F.col("_below")).select(F.substring(text, 1, max_chars).alias("t"), F.col(label).alias("y"), h.alias("h"), F.col(key).alias("k"), long.alias("long"))
    first = F.row_number().over(Window.partitionBy("y").orderBy("long", "h", "k", "t"))
    got = drawn.withColumn("r", first).where(F.col("r") <= per_label).orderBy("y", "r").collect()
    return [(r.t, r.y) for r in got]


def lookup_skewed(rows: DataFrame, found: DataFrame, key: str, weight: str, *, share: int = 1000) -> DataFrame:
    """rows left join found on key, where a key may hold any share of rows.

    found has one row per key and, in weight, the key's number of rows. Keys that hold more than
    1/share of all those rows are fewer than share, so they are broadcast; the others are joined by shuffle,
    where no key is large. weight is not returned.
    """
    total, largest = found.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    least = max(100, total // share)
    if largest <= least:
        return rows.join(found.drop(weight), key, "left")
    hot = F.broadcast(found.where(F.col(weight) > least).drop(weight).withColumn("_hot", F.lit(True)).limit(share))
    cold = found.where(F.col(weight) <= least).drop(weight)
    value = [c for c in found.columns if c not in (key, weight)]
    first = rows.join(hot, key, "left")
    done = first.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = first.where(F.col("_hot").isNull()).drop("_hot", *value)
    return done.unionByName(rest.join(cold, key, "left").select(done.columns))
