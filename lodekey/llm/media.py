"""Media columns: payloads stored as images in archives, read by byte ranges.

A payload becomes an 8-bit greyscale PNG of 64 columns.  Archives hold one
member per document: a 16-byte mark, the lengths and a checksum of header and
image, then both.  The data source ``media_archive`` plans byte ranges over
the files of a folder; a range reads the members whose mark begins in it,
found by scanning for the mark, and streams them in Arrow batches.  A member
that can't be read or fails its checksum is read again by its offset, a few
times, with the file opened anew; others are not affected.

Defined results: null text is empty; an empty payload is 64 zero bytes; ties
and repeated rows are members of their own; a null ``doc_id`` stays null;
extra columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodekey.llm import files, staging

WIDTH = 64
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
SUFFIX = ".media"
MARK = hashlib.sha256(b"lodekey media member").digest()[:16]
_LENGTHS = struct.Struct("<IQII")  # of header and image, their checksum, and that of these three
_PNG = b"\x89PNG\r\n\x1a\n"

MEMBER = "archive string, offset long, doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string"


# ----------------------------------------------------------------------- images


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """The pixels; unfiltered greyscale lines only."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a part of an image is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
            if shape[2:] != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale images are read")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def feature(pixels: np.ndarray) -> str:
    """Mean and deviation, then 64 bits: which of 8 x 8 fields are brighter than the mean."""
    rows = np.linspace(0, len(pixels), 9).astype(int)
    fields = np.zeros((8, 8))
    for i in range(8):
        band = pixels[rows[i] : max(rows[i + 1], rows[i] + 1)]
        band = band if len(band) else pixels[-1:]
        fields[i] = band.reshape(len(band), 8, WIDTH // 8).mean(axis=(0, 2))
    bits = (fields > pixels.mean()).ravel().tolist()
    return f"{pixels.mean():.4f}:{pixels.std():.4f}:{int(''.join('01'[b] for b in bits), 2):016x}"


# --------------------------------------------------------------------- archives


def member(header: dict, body: bytes) -> bytes:
    head = json.dumps(header, separators=(",", ":")).encode()
    lengths = struct.pack("<IQI", len(head), len(body), zlib.crc32(head + body))
    return MARK + lengths + struct.pack("<I", zlib.crc32(lengths)) + head + body


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """One archive per partition, replaced whole when its task runs again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n = f"part-{TaskContext.get().partitionId():06d}{SUFFIX}", 0
        with files.replacing(f"{folder}/{name}") as out:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    out.write(member({"doc_id": doc_id, "n_bytes": len(raw)}, to_png(pad(raw))))
                    n += 1
        yield pa.RecordBatch.from_pydict({"archive": [name], "members": [n]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "archive string, members long")


def parse_member(f, offset: int) -> tuple[dict, bytes, int]:
    """Header, image and end of the member at ``offset``."""
    f.seek(offset)
    fixed = f.read(len(MARK) + _LENGTHS.size)
    if len(fixed) < len(MARK) + _LENGTHS.size or fixed[:16] != MARK:
        raise ValueError("no member begins here")
    n_head, n_body, check, own = _LENGTHS.unpack(fixed[16:])
    if zlib.crc32(fixed[16:32]) != own:
        raise ValueError("a member's lengths are damaged")
    body = f.read(n_head + n_body)
    if len(body) != n_head + n_body or zlib.crc32(body) != check:
        raise ValueError("a member is damaged")
    return json.loads(body[:n_head]), body[n_head:], offset + len(fixed) + len(body)


def read_member(opened: Callable, path: str, offset: int, retries: int = RETRIES, wait: float = 0.2) -> tuple[dict, bytes, int]:
    """Reads one member, again if need be, with the file opened anew."""
    for attempt in range(retries + 1):
        try:
            with opened(path) as f:
                return parse_member(f, offset)
        except (OSError, ValueError):
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def find_mark(f, start: int, stop: int, block: int = 1 << 20) -> int | None:
    """Where the first mark at or after ``start`` and before ``stop`` begins."""
    at, tail = start, b""
    f.seek(start)
    while at - len(tail) < stop:
        got = f.read(block)
        if not got:
            return None
        found = (tail + got).find(MARK)
        if found >= 0:
            found += at - len(tail)
            return found if found < stop else None
        at += len(got)
        tail = (tail + got)[-(len(MARK) - 1) :]
    return None


def members(path: str, start: int, stop: int, opened: Callable = files.reading) -> Iterator[tuple[int, dict, bytes]]:
    """Members whose mark begins in [start, stop)."""
    with opened(path) as f:
        at = find_mark(f, start, stop)
        while at is not None and at < stop:
            try:
                header, body, end = parse_member(f, at)
            except (OSError, ValueError):
                header, body, end = read_member(opened, path, at)
            yield at, header, body
            f.seek(end)
            at = end if f.read(1) else None


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("path", folder).load()``"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return MediaArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), int(self.options.get("batchbytes", BATCH_BYTES)))


class MediaArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, batch_bytes: int):
        self.folder, self.range_bytes, self.batch_bytes = folder, range_bytes, batch_bytes

    def partitions(self) -> list[ByteRange]:
        planned = [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size in files.listing(self.folder, SUFFIX) for at in range(0, size, self.range_bytes)]
        return planned or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        rows: list = []
        size = 0
        for offset, header, png in members(f"{self.folder}/{partition.archive}", partition.start, partition.stop):
            rows.append((partition.archive, offset, header["doc_id"], header["n_bytes"], from_png(png).tobytes(), len(png), hashlib.sha256(png).hexdigest()))
            size += len(rows[-1][4])
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        names = [x.split(" ")[0] for x in MEMBER.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").option("path", folder).option("rangeBytes", range_bytes).load()


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of the payloads read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    b.column("media_bytes"),
                    b.column("media_sha256"),
                    pa.array([feature(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p in payloads]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores the texts of ``docs`` as media and reads them back with features."""
    spark = docs.sparkSession
    staging.ship(spark)
    folder = staging.new_path(spark, "media")
    files.make_folder(folder)
    staging.stage(write_archives(docs, folder), "media-archives")
    return features(read_archives(spark, folder))
