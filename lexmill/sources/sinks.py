"""Writers. Upserts are DataFrame functions in lexmill.operators.merge; their results are written as a new table version."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lexmill.functions.text import file_stem, to_samples


def document(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """One row with a JSON document that lists all rows in order. For small report tables only: the list is one value."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))
    return df.agg(F.to_json(F.struct(rows.alias(field))).alias("value"))


def write_pipe(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="|", header=header, quote='"', escape='"')


def speech_lines(df: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The three columns of speech data sets: file stem, text, text."""
    return df.select(file_stem(F.col(file)).alias("stem"), F.col(text).alias("text"), F.col(text).alias("normalized"))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """A 16-bit mono WAV file of the samples."""

    def encode(s: np.ndarray, r: int) -> bytes:
        data, r = np.asarray(s, "<i2").tobytes(), int(r)
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, r, 2 * r, 2, 16, b"data", len(data)) + data

    return pd.Series([encode(s, r) for s, r in zip(samples, rate, strict=True)])


def cut_segments(audio: DataFrame, segments: DataFrame) -> DataFrame:
    """path, name, content (a WAV file) of segments (path, name, start_ms, end_ms) of audio (path, rate, samples); places are cut to the audio, empty segments give no rows."""
    # sounds stream past the segments of their path, so that samples are neither sorted nor kept; each segment takes its own samples alone
    each = audio.join(segments.groupBy("path").agg(F.collect_list(F.struct("name", "start_ms", "end_ms")).alias("_cuts")).hint("shuffle_hash"), "path")
    place = lambda c: to_samples(c, F.col("rate"), F.lit(0).cast("long"), F.size("samples").cast("long"))
    at = F.transform("_cuts", lambda c: F.struct(c["name"].alias("name"), place(c["start_ms"]).alias("a"), place(c["end_ms"]).alias("z")))
    some = each.withColumn("_at", F.filter(at, lambda c: c["z"] > c["a"]))
    parts = F.transform("_at", lambda c: F.struct(c["name"].alias("name"), F.slice("samples", (c["a"] + 1).cast("int"), (c["z"] - c["a"]).cast("int")).alias("_s")))
    return some.select("path", "rate", F.inline(parts)).select("path", "name", wav_bytes("_s", "rate").alias("content"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, batch after batch; also how feedback is kept."""
    df.write.mode("append").json(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
