"""JSON, delimited, record-separated and binary files."""

from __future__ import annotations

import io
import urllib.request
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.functions.text import null_if_blank, split_words, strip

PARSED = "dictionary array<struct<tol string, spanish string, category string, section string>>, sentences array<struct<tol string, spanish string, source string>>"


def json_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array of objects; fields that are missing are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def page_map(spark: SparkSession, path: str) -> DataFrame:
    """page, text of a JSON object from page numbers to texts."""
    return page_rows(spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("pages")))


def page_rows(maps: DataFrame, column: str = "pages") -> DataFrame:
    return maps.select(F.explode(column).alias("page", "text")).select(F.col("page").cast("int").alias("page"), "text")


def parsed_dictionary(spark: SparkSession, path: str, schema: str = PARSED) -> tuple[DataFrame, DataFrame]:
    """The entries and the sentences of a parsed dictionary; a missing list is empty."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.inline(F.coalesce("dictionary", F.array()))), doc.select(F.inline(F.coalesce("sentences", F.array())))


def pair_columns(line: Column) -> tuple[Column, Column]:
    """The two fields of a line parted by a tab, else by white space; null if there are not two."""
    by_tab, by_space = F.split(line, "\t"), split_words(line)
    parts = F.when(F.size(by_tab) == 2, by_tab).when(F.size(by_space) == 2, by_space)
    return null_if_blank(F.get(parts, F.lit(0))), null_if_blank(F.get(parts, F.lit(1)))


def word_pairs(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    a, b = pair_columns(F.col("value"))
    return spark.read.text(path).select(a.alias(names[0]), b.alias(names[1])).where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """With a header; quotes doubled as csv writers do."""
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"')


def adjacency(lines: DataFrame, column: str = "value", sep: str = ",") -> DataFrame:
    """word, synonym edges of lines 'root,synonym,...' without loops."""
    parts = F.filter(F.transform(F.split(column, sep), lambda w: F.lower(strip(w))), lambda w: w != "")
    rows = lines.select(F.get(parts, F.lit(0)).alias("word"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).alias("synonym"))
    return rows.where("word <> synonym").distinct()


def group_members(groups: DataFrame, column: str) -> DataFrame:
    """group_id, pos, word of lists of terms, of which each may hold several parted by commas."""
    flat = F.filter(F.transform(F.flatten(F.transform(column, lambda t: F.split(t, ","))), lambda w: F.lower(strip(w))), lambda w: w != "")
    return groups.select("group_id", F.posexplode(F.array_distinct(flat)).alias("pos", "word"))


def records(spark: SparkSession, path: str, separator: str = "_____\n") -> DataFrame:
    """headword, pos, gloss of records parted by the separator: first line the word, 'pos:' lines set the state for the 'gloss:' lines after them."""
    rows = spark.read.text(path, lineSep=separator).select(F.monotonically_increasing_id().alias("rec"), F.split("value", "\n").alias("lines"))
    lines = rows.select("rec", F.get("lines", F.lit(0)).alias("headword"), F.posexplode("lines").alias("pos_no", "line"))
    value = lambda name: F.when(F.col("line").startswith(name), strip(F.expr(f"substring(line, {len(name) + 1})")))
    before = Window.partitionBy("rec").orderBy("pos_no").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.select("rec", strip(F.col("headword")).alias("headword"), "pos_no", F.last(value("pos:"), ignorenulls=True).over(before).alias("pos"), value("gloss:").alias("gloss"))
    return held.where("gloss IS NOT NULL AND headword <> ''").select("headword", "pos", "gloss")


def pcm(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples of 16-bit WAV files, of several channels the first."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with wave.open(io.BytesIO(content.as_py())) as w:
                    samples = np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()].astype(np.int32)
                    held = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([w.getframerate()], pa.int32()), held], ["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, rate int, samples array<int>")


def split_gzip(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """pos, chunk of what a gzip file holds that was split into parts, in the order of their names. A gzip stream can't be entered in its middle, so it is one task's work."""

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, pos = zlib.decompressobj(31), 0
        for b in batches:
            for content in b.column("content"):
                data = content.as_py()
                while data:
                    out = stream.decompress(data, chunk)
                    data = stream.unconsumed_tail
                    if stream.eof:  # another member may follow
                        data, stream = stream.unused_data, zlib.decompressobj(31)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([pos], pa.int64()), pa.array([out], pa.binary())], ["pos", "chunk"])
                        pos += len(out)

    parts = spark.read.format("binaryFile").load(path).select("path", "content")
    return parts.repartition(1).sortWithinPartitions("path").mapInArrow(inflate, "pos long, chunk binary")


def word_list(spark: SparkSession, url: str, timeout: float = 10) -> DataFrame:
    """word of a list, a word a line, that is fetched from an address; no rows if it can't be had. For lists that the driver can hold."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as got:
            words = [w.strip() for w in got.read().decode("utf-8", "replace").splitlines() if w.strip()]
    except (OSError, ValueError):
        words = []
    return spark.createDataFrame([(w,) for w in words], "word string")


def frames(audio: DataFrame, ms: int = 10) -> DataFrame:
    """path, frame, rms of every frame of so many milliseconds; a last part frame is dropped."""
    n = (F.col("rate") * ms / 1000).cast("int")
    starts = F.sequence(F.lit(0), F.floor(F.size("samples") / n).cast("int") - 1)
    rows = audio.where(F.size("samples") >= n).select("path", F.posexplode(F.transform(starts, lambda i: F.slice("samples", i * n + 1, n))).alias("frame", "s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("path", "frame", F.sqrt(total / F.size("s")).alias("rms"))


def prefixed(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The metadata rows whose column begins with the prefix."""
    return rows.where(F.col(column).startswith(prefix))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, stem, mtime, length of the files below path whose names fit; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return found.select("path", stem.alias("stem"), F.col("modificationTime").alias("mtime"), "length")


def not_done(files: DataFrame, done: DataFrame, stem: str = "stem") -> DataFrame:
    """Files whose stem has no result yet."""
    return files.join(done.select(stem).distinct(), stem, "left_anti")


def latest(files: DataFrame, dir_rank: str, mtime: str, name: str, prefer: str = "best_model") -> DataFrame:
    """The one artifact to use: lowest directory rank, preferred name, newest."""
    return files.orderBy(dir_rank, F.when(F.col(name).contains(prefer), 0).otherwise(1), F.desc(mtime), name).limit(1)
