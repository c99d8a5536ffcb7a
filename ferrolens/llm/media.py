"""Operator 7: media columns read through a Spark data source of its own.

`store_media` writes payloads as 8-bit greyscale PNG images, 64 samples wide, into ZIP archives of
a shared folder; `MediaSource` (format "media_archive") reads archive folders back:

* Planning lists the archives and their sizes only, and cuts each into byte ranges. A task reads
  its archive's own directory and takes the members whose header starts within its range, so
  neither the driver nor a task ever holds a list of all members.
* Members stream back as Arrow batches of bounded bytes.
* Every member is read by offset on its own. A failed or corrupt read is repeated alone, with a
  fresh handle, up to `retries` times; what stays unreadable is a row with a null payload and the
  error's text (mode "permissive") or fails the task (mode "strict", the default).

Archives are opened through pyarrow's file systems, so the folder may be any that those know.
A task writes an archive under a temporary name and renames it when it is whole; its name depends
on the partition alone, so a repeated task replaces its own work and nothing else.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ferrolens.llm.frames import pick, shared_folder, slices, table

WIDTH = 64
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20

# Fixed values of the formats: PNG's signature and ZIP's record signatures.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ZIP_LOCAL, ZIP_ENTRY, ZIP_END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"


# -- the image format ------------------------------------------------------------------------------


def pad(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of WIDTH."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: bytes, note: str = "") -> bytes:
    """A lossless greyscale image of rows of WIDTH samples; note goes to a text chunk."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    text = _chunk(b"tEXt", b"n\0" + note.encode("latin-1")) if note else b""
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + text + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def unpng(data: bytes) -> tuple[bytes, str]:
    """Samples and note of an image that png() made; raises ValueError on any damage."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, note, packed, size = 8, "", b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt":
            note = body[2:].decode("latin-1")
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), note


# -- archives --------------------------------------------------------------------------------------


class ArchiveWriter:
    """A ZIP file of stored (uncompressed) members, written from front to back."""

    def __init__(self, sink):
        self.sink, self.at, self.entries = sink, 0, []

    def add(self, name: str, data: bytes) -> None:
        label = name.encode("utf-8")
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(label), 0)
        self.entries.append(ZIP_ENTRY + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + label)
        for part in (ZIP_LOCAL, common, label, data):
            self.sink.write(part)
            self.at += len(part)

    def close(self) -> None:
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.sink.write(directory + ZIP_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), len(directory), self.at, 0))
        self.sink.close()

    @property
    def full(self) -> bool:
        return self.at >= ARCHIVE_BYTES or len(self.entries) >= 0xFFFE


@dataclass
class Member:
    name: str
    offset: int
    size: int
    crc: int


def directory(source, size: int) -> list[Member]:
    """The members that the archive's own directory lists."""
    tail = min(size, 1 << 16)
    source.seek(size - tail)
    end = source.read(tail)
    at = end.rfind(ZIP_END)
    if at < 0:
        raise ValueError("no archive directory")
    n, length, start = struct.unpack_from("<HII", end, at + 10)
    source.seek(start)
    listing, out, at = source.read(length), [], 0
    for _ in range(n):
        if listing[at : at + 4] != ZIP_ENTRY:
            raise ValueError("damaged archive directory")
        crc, stored, _, label, extra, comment = struct.unpack_from("<IIIHHH", listing, at + 16)
        (offset,) = struct.unpack_from("<I", listing, at + 42)
        out.append(Member(listing[at + 46 : at + 46 + label].decode("utf-8"), offset, stored, crc))
        at += 46 + label + extra + comment
    return out


def read_member(source, member: Member) -> bytes:
    """The member's bytes, by offset; raises on short reads and damage."""
    source.seek(member.offset)
    head = source.read(30)
    if head[:4] != ZIP_LOCAL:
        raise OSError(f"no member at {member.offset}")
    label, extra = struct.unpack_from("<HH", head, 26)
    source.seek(member.offset + 30 + label + extra)
    data = source.read(member.size)
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise OSError(f"damaged member {member.name}")
    return data


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pafs.LocalFileSystem(), uri)


def store_media(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every text's UTF-8 bytes, padded, as an image into archives of `folder`.

    Returns one row for each archive: path, members, bytes. Null texts are empty payloads, which
    pad to 64 bytes; null keys stay null; repeated rows are members of their own.
    """
    rows = pick(df, id=key, text=text).withColumn("id", F.col("id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        writer, made, row, number = None, [], 0, 0

        def finish() -> None:
            writer.close()
            fs.move(writing, final)
            made.append((final, len(writer.entries), fs.get_file_info(final).size))

        for batch in batches:
            for piece in slices(batch, 1):
                for key_, value in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if writer is None:
                        final = f"{base}/part-{task.partitionId():06d}-{number:04d}.zip"
                        writing = f"{base}/_{uuid.uuid4().hex}.tmp"
                        writer = ArchiveWriter(fs.open_output_stream(writing))
                    payload = value or b""
                    writer.add(f"{row}/{'' if key_ is None else key_}", png(pad(payload), str(len(payload))))
                    row += 1
                    if writer.full:
                        finish()
                        writer, number = None, number + 1
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "members", "bytes"])

    return rows.mapInArrow(run, "path string, members long, bytes long")


# -- the data source -------------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    start: int
    end: int


SCHEMA = "key string, n_bytes long, payload binary, media binary, attempts int, error string"
ARROW = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.strict = options.get("mode", "strict") == "strict"

    def partitions(self) -> list[ByteRange]:
        fs, base = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        archives = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))
        ranges = [ByteRange(p, n, a, min(n, a + self.range_bytes)) for p, n in archives for a in range(0, n, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _open(self.folder)
        open_ = lambda: fs.open_input_file(part.path)
        source = open_()
        rows, held = [], 0
        for member in directory(source, part.size):
            if not part.start <= member.offset < part.end:
                continue
            row, source = self._member(open_, source, member)
            rows.append(row)
            held += member.size + len(row[2] or b"")
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _member(self, open_, source, member: Member):
        key = member.name.partition("/")[2] or None
        for attempt in range(1, self.retries + 2):
            try:
                media = read_member(source, member)
                payload, note = unpng(media)
                return (key, int(note), payload, media, attempt, None), source
            except (OSError, ValueError, zlib.error) as e:
                error = str(e)
                if attempt <= self.retries:
                    time.sleep(min(0.05 * 2**attempt, 2))
                    source = open_()
        if self.strict:
            raise OSError(f"{member.name} at {member.offset}: {error}")
        return (key, None, None, None, attempt, error), source

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


class MediaSource(DataSource):
    """spark.read.format("media_archive").option("rangeBytes", ...).option("retries", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(**options).load(folder)


# -- features --------------------------------------------------------------------------------------


def feature(payload: bytes) -> str:
    """Height, mean sample, and a 64-bit difference hash of the image scaled to 8 rows and 9 columns."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    rows = np.linspace(0, len(image), 9).astype(int)
    columns = np.linspace(0, WIDTH, 10).astype(int)
    sums = np.zeros((len(image) + 1, WIDTH + 1))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    lo, hi = np.minimum(rows[:-1], len(image) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(image) - 1) + 1)
    area = (hi - lo)[:, None] * np.diff(columns)
    cells = (sums[hi][:, columns[1:]] - sums[hi][:, columns[:-1]] - sums[lo][:, columns[1:]] + sums[lo][:, columns[:-1]]) / area
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"h={len(image)};mean={image.mean():.4f};dhash={bits}"


def media_features(df: DataFrame) -> DataFrame:
    """Sizes, digests and the feature of what read_media gives; key as it was stored."""
    schema = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                rows = list(zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                columns = (
                    [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [sha(r[2]) for r in rows], [zlib.crc32(r[2][-WIDTH:]) for r in rows],
                    [len(r[3]) for r in rows], [sha(r[3]) for r in rows], [feature(r[2]) for r in rows],
                )
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split(" ")[0] for c in schema.split(", ")])

    return df.filter(F.col("payload").isNotNull()).select("key", "n_bytes", "payload", "media").mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/media"
    store_media(documents, folder).write.format("noop").mode("overwrite").save()
    return media_features(read_media(spark, folder)).select(F.col("key").cast("long").alias("doc_id"), *media_columns())


def media_columns() -> list[str]:
    return ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
