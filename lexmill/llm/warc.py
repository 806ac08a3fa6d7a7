"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so they reach any file system that Spark can write and
follow its commit protocol when executors are lost: a row is a frame's bytes, and the line separator is an
empty skippable frame, which every Zstandard decoder passes over. A file holds the dictionary frame and then
FILE_ROWS - 1 frames at most; when a file has FILE_BYTES, empty rows fill it up.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import lookup_skewed, shared_dir, small_batches, stored

# Fixed values of the formats: magic numbers, and the profile of revisit records.
DICTIONARY_MAGIC, SKIPPABLE, FRAME, RAW_DICTIONARY = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A valid skippable frame without content, all of it ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
FILE_ROWS, FILE_BYTES = 1024, 16 << 20
#: Bounds of the dictionary's sample, and its size.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 60_000, 16_384
#: Equal payloads from this length on are written once.
REVISIT_LEAST = 100
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def one_line(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit without payload. Dates are fixed, so a task that runs again writes the same bytes."""
    block = b"" if refers_to is not None else HEAD.format(len(payload)).encode() + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """Parse and validate one record: version, needed headers, lengths, end marks, digest of a response's payload."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC version line: {version[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise WarcError(f"bad or repeated header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"content length {headers['content-length']} does not hold: {len(rest) - 4}")
    block = rest[:-4]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if headers["warc-type"] == "revisit":
        if block or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE or not digest:
            raise WarcError("revisit with a block, or without reference, profile or digest")
        return Record(headers, b"")
    http, mark, payload = block.partition(b"\r\n\r\n")
    stated = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not mark or not http.startswith(b"HTTP/") or stated != [b"%d" % len(payload)]:
        raise WarcError("HTTP head or its content length does not hold")
    if digest != hashlib.sha256(payload).hexdigest() or headers.get("x-payload-length", str(len(payload))) != str(len(payload)):
        raise WarcError("the payload differs from its digest or length")
    return Record(headers, payload)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading frame; empty without a dictionary."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of every frame; for skippable frames their content. Walks block headers, decodes nothing."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("cut off in a frame's head")
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + n
            content = data[at + 8 : end]
        elif magic == FRAME:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                if end + 3 > len(data):
                    raise WarcError("cut off in a block's head")
                block = int.from_bytes(data[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 if data[at + 4] & 4 else 0  # checksum
            content = data[at:end]
        else:
            raise WarcError(f"no frame at {at}: {magic:#x}")
        if end > len(data):
            raise WarcError("cut off in a frame")
        yield magic, content
        at = end


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of one archive. The dictionary, plain or itself compressed, comes from the first frame, if that is skippable with the dictionary's magic."""
    decoder = zstandard.ZstdDecompressor()
    for k, (magic, content) in enumerate(frames(memoryview(data))):
        if magic == DICTIONARY_MAGIC:
            if k:
                raise WarcError("a dictionary that does not lead the archive")
            raw = bytes(content)
            if struct.unpack_from("<I", raw)[0] == FRAME:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            if struct.unpack_from("<I", raw)[0] != RAW_DICTIONARY:
                raise WarcError("the dictionary frame holds no dictionary")
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME:
            try:
                yield decode_record(decoder.decompressobj().decompress(content))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame {k}: {e}") from e


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages of at most SAMPLE_CHARS characters, drawn by a hash of the id; b"" if they are too few."""
    drawn = pages.select("page_id").where("page_id IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).distinct()
    same = pages.join(F.broadcast(drawn), "page_id", "left_semi").where(F.length("html").between(1, SAMPLE_CHARS))
    rows = same.groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()  # ids first: tasks send no more pages than are drawn
    if len(rows) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:  # the samples are too small
        return b""


def write_archives(pages: DataFrame, path: str, dictionary: bytes = b"", level: int = 3) -> None:
    """Write page_id, url, html and refers_to (null: a response) as archives below path, a record per row."""
    small_batches(pages.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        lead, rows, size = dictionary_frame(dictionary), 0, 0
        for b in batches:
            out = []
            for page, url, html, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                if size >= FILE_BYTES and rows % FILE_ROWS:
                    fill = -rows % FILE_ROWS
                    out += [b""] * fill
                    rows += fill
                if rows % FILE_ROWS == 0:
                    out.append(lead)
                    rows, size = 1, 0
                out.append(encoder.compress(encode_record(page, url, html or b"", refers)))
                rows, size = rows + 1, size + len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    frames_ = pages.select("page_id", "url", "html", "refers_to").mapInArrow(encode, "value binary")
    frames_.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_ROWS).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below path, whatever file system: page_id, url, payload (null for revisits),
    payload_bytes, payload_digest, record_type, refers_to. A record that breaks the format fails the query."""
    small_batches(spark)  # rows are whole archives; Arrow's bound on a batch's bytes cuts their batches

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for data in b.column("content").to_pylist():
                out: list[list] = [[] for _ in names]
                held = 0

                def flush(out: list[list]) -> pa.RecordBatch:
                    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    for c in out:
                        c.clear()
                    return batch

                for r in read_archive(data):
                    h, revisit = r.headers, r.headers["warc-type"] == "revisit"
                    row = (page(h["warc-record-id"]), h.get("warc-target-uri"), None if revisit else r.payload.decode(), int(h["x-payload-length"]) if revisit else len(r.payload), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], page(h.get("warc-refers-to")))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    held += len(r.payload)
                    if held > 8 << 20:
                        yield flush(out)
                        held = 0
                yield flush(out)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(decode, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload of at least REVISIT_LEAST bytes, if that is another.

    Rows that share the smallest id are all responses; rows without an id are responses and are never referred to.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    of = stored(pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= REVISIT_LEAST)).select("page_id", digest.alias("digest")), "digests")
    first = of.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    revisits = lookup_skewed(of, first, "digest", "n").where(F.col("first_id") < F.col("page_id"))
    again = revisits.select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length("html") >= REVISIT_LEAST, digest).alias("digest"))
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def op2_warc(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back. No pages: no records."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(with_revisits(pages), path, train_dictionary(pages))
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN n >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)"""
