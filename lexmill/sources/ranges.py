"""Audio as a Python data source whose partitions are ranges of frames: an hour of sound is many partitions, and no row holds a file.

    spark.dataSource.register(WavFrames)
    spark.read.format("wav_frames").option("path", folder).option("frame_ms", 10).load()

The driver looks through folders, keeps none of their short files' names and reads the headers of files that are longer than a partition may be. Folders of short files share partitions (a folder
of many is dealt to several by their names), whose tasks list them again; so files are not to change while they are read. A partition opens its files and reads its own bytes. Files are
reached through Arrow's file systems, so a path may be a local folder or an address they know. Filters on path and frame are
pushed to the planning of partitions where spark.sql.python.filterPushdown.enabled is set (and the option pushdown says so,
as wav_frames does), and cut their ranges.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Header:
    """Of a 16-bit PCM file: channels, frames a second, where samples begin, and how many of each channel there are."""

    channels: int
    rate: int
    begin: int
    samples: int

    @classmethod
    def of(cls, f: pa.NativeFile) -> Header:
        riff, _, kind = struct.unpack("<4sI4s", f.read(12))
        if riff != b"RIFF" or kind != b"WAVE":
            raise ValueError("not a WAV file")
        channels = rate = width = 0
        while True:
            name, size = struct.unpack("<4sI", f.read(8))
            if name == b"fmt ":
                _, channels, rate, _, _, width = struct.unpack("<HHIIHH", f.read(16))
                f.seek(f.tell() + size - 16 + (size & 1))
            elif name == b"data":
                if width != 16 or not channels:
                    raise ValueError("samples of 16 bits are read")
                return cls(channels, rate, f.tell(), min(size, f.size() - f.tell()) // (2 * channels))
            else:
                f.seek(f.tell() + size + (size & 1))


#: A folder of short files is dealt to at most so many partitions, as each of them lists it.
SLICES = 32


def entries(system: fs.FileSystem, root: str, folder: str, wanted: Callable[[str], bool]) -> Iterator[tuple[str, int | None]]:
    """Names below root of a folder's wanted files with their sizes, and of its folders without one. Of a local folder one entry at a time is held."""
    at, before = f"{root.rstrip('/')}/{folder}", f"{folder}/" if folder else ""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                name = before + e.name
                if e.is_dir():
                    yield name, None
                elif wanted(name):
                    try:
                        yield name, e.stat().st_size
                    except FileNotFoundError:  # moved since
                        continue
    else:
        for info in system.get_file_info(fs.FileSelector(at)):
            name = before + info.base_name
            if info.type == fs.FileType.Directory:
                yield name, None
            elif wanted(name):
                yield name, info.size


class Stretch(InputPartition):
    """Frames first to last of each of the files; of files shorter than last as many as they have. slices: folders whose short files are meant, with the number of a slice and of all slices."""

    def __init__(self, paths: list[str], first: int, last: int, slices: list[tuple[str, int, int]] | None = None) -> None:
        self.paths, self.first, self.last, self.slices = paths, first, last, slices or []


class WavFramesReader(DataSourceReader):
    def __init__(self, path: str, frame_ms: int, frames: int) -> None:
        self.path, self.frame_ms, self.frames = path, frame_ms, frames
        self.only: list[str] | None = None
        self.low, self.high = 0, 1 << 62

    def wanted(self, name: str) -> bool:
        """Whether it is a sound that is asked for; a name with a dot in front is a file that is being written."""
        return name.endswith(".wav") and not name.rpartition("/")[2].startswith(".") and (self.only is None or name in self.only)

    def short(self, size: int) -> bool:
        """Whether it has fewer frames than a partition, whatever its rate: its header is read in the task."""
        return 44 < size <= 2 * self.frames

    def partitions(self) -> list[Stretch]:
        system, root = located(self.path)
        out, some, size, folders = [], [], 0, [""]
        while folders:
            folder, held = folders.pop(), 0
            for name, length in entries(system, root, folder, self.wanted):
                if length is None:
                    folders.append(name)
                elif self.short(length):
                    held += length
                else:
                    out += self.stretches(system, root, name)
            n = min(SLICES, -(-held // (2 * self.frames)))
            if n > 1:
                out += [Stretch([], self.low, self.high, [(folder, k, n)]) for k in range(n)]
            elif n:
                if some and size + held > 2 * self.frames:
                    out.append(Stretch([], self.low, self.high, some))
                    some, size = [], 0
                some.append((folder, 0, 1))
                size += held
        return [*out, Stretch([], self.low, self.high, some)] if some else out

    def stretches(self, system: fs.FileSystem, root: str, name: str) -> list[Stretch]:
        """Of a file that may be longer than a partition."""
        with system.open_input_file(f"{root.rstrip('/')}/{name}") as f:
            h = Header.of(f)
        whole = h.samples // (h.rate * self.frame_ms // 1000)
        low, high = max(0, self.low), min(whole - 1, self.high)
        return [Stretch([name], at, min(at + self.frames - 1, high)) for at in range(low, high + 1, self.frames)]

    def names(self, system: fs.FileSystem, root: str, part: Stretch) -> Iterator[str]:
        yield from part.paths
        for folder, k, n in part.slices:
            for name, length in entries(system, root, folder, lambda x: self.wanted(x) and crc32(os.fsencode(x)) % n == k):  # noqa: B023
                if length is not None and self.short(length):
                    yield name

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        system, root = located(self.path)
        for path in self.names(system, root, part):
            with system.open_input_file(f"{root.rstrip('/')}/{path}") as f:
                h = Header.of(f)
                n = h.rate * self.frame_ms // 1000
                last = min(part.last, h.samples // n - 1)
                for at in range(part.first, last + 1, 1000):
                    end = min(at + 1000, last + 1)
                    f.seek(h.begin + 2 * h.channels * n * at)
                    s = np.frombuffer(f.read(2 * h.channels * n * (end - at)), "<i2")[:: h.channels].astype(np.float64).reshape(end - at, n)
                    rms = np.sqrt((s * s).sum(1) / n)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * (end - at)), pa.array(np.arange(at, end)), pa.array(np.full(end - at, h.rate), pa.int32()), pa.array(rms)], ["path", "frame", "rate", "rms"])


class FilteredReader(WavFramesReader):
    """Spark refuses a reader that takes filters unless its setting allows it, so this one is used only then."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = [f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("frame",):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("frame",):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("frame",):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


class WavFrames(DataSource):
    """path (below the folder), frame, rate and rms of every whole frame of frame_ms; of several channels the first. partition_frames: how many frames a partition has."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return "path string, frame long, rate int, rms double"

    def reader(self, schema) -> WavFramesReader:
        kind = FilteredReader if self.options.get("pushdown", "false").lower() == "true" else WavFramesReader
        return kind(self.options["path"], int(self.options.get("frame_ms", "10")), int(self.options.get("partition_frames", "60000")))


class Written(WriterCommitMessage):
    pass


class FilesWriter(DataSourceArrowWriter):
    """Each file is written under a name of its own and then moved, so a task that runs again leaves whole files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        made: set[str] = set()
        task = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):  # one content at a time, as it lies in the batch
                name = name.as_py()
                folder, _, last = f"{root.rstrip('/')}/{name}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/.{task}-{last}") as f:
                    f.write(content.as_buffer())
                system.move(f"{folder}/.{task}-{last}", f"{folder}/{last}")
        return Written()


#: Bytes of a partition of whole files, each file being counted as so many more; bytes of the rows that are handed on at once.
PART, OPENED, HANDED = 16 << 20, 16 << 10, 1 << 20


class FilesReader(DataSourceReader):
    """Of folders below a path the files whose names begin and end in one of these ways. As with sounds, partitions are folders or slices of them, which their tasks list again."""

    def __init__(self, path: str, folders: list[str], begin: list[str], end: str) -> None:
        self.path, self.folders, self.begin, self.end = path, folders, tuple(begin), end

    def wanted(self, name: str) -> bool:
        last = name.rpartition("/")[2]
        return last.endswith(self.end) and last.startswith(self.begin) and last[0] not in "._"

    def partitions(self) -> list[Stretch]:
        system, root = located(self.path)
        out, some, size = [], [], 0
        for folder in self.folders:
            held = sum(OPENED + length for _, length in entries(system, root, folder, self.wanted) if length is not None)
            n = min(SLICES, -(-held // PART))
            if n > 1:
                out += [Stretch([], 0, 0, [(folder, k, n)]) for k in range(n)]
            elif n:
                if some and size + held > PART:
                    out.append(Stretch([], 0, 0, some))
                    some, size = [], 0
                some.append((folder, 0, 1))
                size += held
        return [*out, Stretch([], 0, 0, some)] if some or not out else out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        system, root = located(self.path)
        rows, size = [], 0
        for folder, k, n in part.slices:
            for name, length in entries(system, root, folder, lambda x: self.wanted(x) and crc32(os.fsencode(x)) % n == k):  # noqa: B023
                if length is None:
                    continue
                with system.open_input_file(f"{root.rstrip('/')}/{name}") as f:
                    rows.append((name, f.read()))
                size += length
                if size >= HANDED:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "content"])


class Files(DataSource):
    """Writes rows of a name (also with folders) and a content as files below a folder; rows that share a name replace each other. Reads files of its folders (options folders, begin and end)."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], json.loads(self.options["folders"]), json.loads(self.options["begin"]), self.options["end"])

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def wav_frames(spark: SparkSession, path: str, frame_ms: int = 10, partition_frames: int = 60_000) -> DataFrame:
    spark.dataSource.register(WavFrames)
    return spark.read.format("wav_frames").option("path", path).option("frame_ms", frame_ms).option("partition_frames", partition_frames).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load()


#: Rows that are handed to the writer at once; contents may hold a megabyte each.
_ROWS, AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 32


def write_files(rows: DataFrame, path: str) -> None:
    """rows of name and content, as files of the folder."""
    spark = rows.sparkSession
    spark.dataSource.register(Files)
    old = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(AT_ONCE))
    try:
        rows.select("name", "content").write.format("whole_files").mode("append").option("path", path).save()
    finally:
        spark.conf.set(_ROWS, old)


def reachable(path: str) -> bool:
    """Whether it is one folder of a file system that Arrow knows."""
    try:
        return bool(path) and not set("*?[{") & set(path) and located(path) is not None
    except (OSError, ValueError):
        return False


def read_files(spark: SparkSession, path: str, folders: list[str], begin: list[str] | None = None, end: str = "") -> DataFrame:
    """name (below path) and content of the files of these folders, without the folders in them."""
    spark.dataSource.register(Files)
    return spark.read.format("whole_files").option("path", path).option("folders", json.dumps(folders)).option("begin", json.dumps(begin or [""])).option("end", end).load()
