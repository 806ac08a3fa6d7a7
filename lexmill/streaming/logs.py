"""File streams with watermarks, runs by a state of each key, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lexmill.operators.buckets import Buckets
from lexmill.operators.merge import upsert_max

PROGRESS = "ts_utc timestamp, global_step long, epoch long, avg map<string,double>"


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def windowed(events: DataFrame, ts: str, value: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, keys, n, total by tumbling window; rows later than the watermark are dropped by Spark."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def every_step(progress: DataFrame, step: int = 250) -> DataFrame:
    return progress.where(F.col("global_step") % step == 0)


def rewrite_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off all that is there; each batch replaces the result by the windows as they then are. Nothing passes through the driver."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)  # the result if there is nothing
    replace = lambda df, _: df.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, table: Buckets, checkpoint: str, column: str, order: list[str]) -> None:
    """Merge each micro-batch into the buckets it touches, the larger value of the column staying; a batch that runs again after a failure changes nothing."""

    def merge(batch: DataFrame, n: int) -> None:
        table.apply(batch, lambda old, new: upsert_max(old, new, table.keys, column, order), n + 1)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once_each(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark; state of keys that it has passed is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, ts: str, value: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """keys, first_ts, end_ts, n, total of runs of events of a key that lie less than gap apart; a session is given out once the watermark has passed its end. In a batch query all sessions are."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("_w.start").alias("first_ts"), F.col("_w.end").alias("end_ts"), "n", "total")


def quiet_runs(events: DataFrame, ts: str, inside, keys: list[str], gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """keys, first_ts, end_ts, n, total: sessions of the events for which inside holds, as runs below a threshold are found in a stream."""
    return sessions(events.where(inside).withColumn("_one", F.lit(1)), ts, "_one", keys, gap, late)


def closed_runs(events: DataFrame, ts: str, tie: str, inside: Column, keys: list[str], least: int = 1, late: str = "2 hours") -> DataFrame:
    """keys, first_ts, last_ts, n of a stream's maximal runs of rows of a key where inside holds, of at least so many rows.

    The rows' order is ts, then tie (whole numbers), whatever order they come in: rows wait in the key's state until the
    watermark passes them, a timer wakes a key without new rows, and a run is given out once a row outside it has been passed.
    State is the rows that the watermark has not passed and one open run a key; a key without either has none. Rows
    later than the watermark are dropped by Spark, those without ts here; a null in inside or keys counts as outside, or as a key of its own.
    """
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = stamped.select(*keys, ts, F.unix_micros(ts).alias("_at"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("_tie"), F.coalesce(inside, F.lit(False)).alias("_in"))

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, first, last, n = state.get if state.exists else ([], 0, 0, 0)
        waiting = [tuple(w) for w in waiting]
        for b in batches:
            waiting += zip(b["_at"].tolist(), b["_tie"].tolist(), b["_in"].tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        done: list[tuple] = []
        settled = 0
        for at, _, within in waiting:
            if at > passed:
                break
            settled += 1
            if within:
                first, last, n = first if n else at, at, n + 1
            else:
                if n >= max(1, least):
                    done.append((*key, first, last, n))
                n = 0
        waiting = waiting[settled:]
        if waiting or n:
            state.update((waiting, first, last, n))
            if waiting:
                state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=[*keys, "_first", "_last", "n"])

    out = StructType([rows.schema[k] for k in keys]).add("_first", "long").add("_last", "long").add("n", "long")
    held = "waiting array<struct<at: long, tie: long, inside: boolean>>, first long, last long, n long"
    runs = rows.groupBy(*keys).applyInPandasWithState(settle, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select(*keys, F.timestamp_micros("_first").alias("first_ts"), F.timestamp_micros("_last").alias("last_ts"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off what is new, in append mode; the rows given out so far."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def follow(spark: SparkSession, source: str, schema, make, path: str, checkpoint: str, files: int = 1) -> DataFrame:
    """drain by make (stream to stream) of a folder of Parquet files, some files a micro-batch."""
    return drain(make(file_stream(spark, source, schema, files=files)), path, checkpoint)
