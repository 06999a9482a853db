"""WARC archives: writing, reading, and transaction assembly.

Each capture is three records, as a crawler writes them: a response (or a
revisit, when another capture holds the same payload), its request and its
metadata.  The latter two name the first in ``WARC-Concurrent-To``.  Records
are gzip members of their own, so an archive can be read from any of them.

Assembly reads records back and joins request, response and metadata through
the concurrent-to identifiers into one nested row per capture.  A revisit
carries no payload; its length and digest are those of the response that it
refers to, found by a join on record ids.

Defined results: null html is an empty payload; all payloads of at least
``min_bytes`` bytes are deduplicated, the row with the largest ``page_id``
being the response (all rows with that id are responses; where every id is
null, one row is); each row of ``pages`` is a capture with identifiers of its
own, repeated rows too; null url is ``about:blank``; a null ``page_id`` sorts
below every other and its record refers and is referred to as usual; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekey.llm import files, staging

MIN_BYTES = 0
MOST_READERS = 50_000  # tasks that read archives; each reads one or more
_DATE = "2024-01-01T00:00:00Z"  # captures carry no time of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URL

WRITTEN = "archive string, records long"
RECORD = "record_id string, concurrent_to string, kind string, url string, page_id long, declared_bytes long, declared_digest string, payload_bytes long, payload_digest string, refers_to_id string, archive string, offset long, fields map<string,string>, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind}:{page}')}>"


def one_line(s: str | None) -> str:
    """A header value: line ends would end the header."""
    return "about:blank" if s is None else s.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def capture(page_id: int | None, key: str, url: str | None, html: bytes, digest: str, owner: str | None, owner_page: int | None) -> bytes:
    """The three records of one capture; ``owner`` is the response it repeats."""
    url, kind = one_line(url), "response" if owner is None else "revisit"
    rid = record_id(key, "capture")
    page = "" if page_id is None else str(page_id)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", url), ("X-Page-Id", page)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    main = [("WARC-Type", kind), ("WARC-Record-ID", rid), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if owner is not None:
        main += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(owner, "capture")), ("X-Refers-To-Page-Id", "" if owner_page is None else str(owner_page))]
    out = record(main, http + (html if owner is None else b""))
    host = url.split("://", 1)[-1].split("/", 1)[0]
    out += record(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id(key, "request")), ("WARC-Concurrent-To", rid), *common, ("Content-Type", "application/http; msgtype=request")],
        f"GET {url} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
    )
    return out + record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(key, "metadata")), ("WARC-Concurrent-To", rid), *common, ("Content-Type", "application/warc-fields")],
        f"via: {url}\r\nfetchedBytes: {len(html)}\r\n".encode(),
    )


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, rest[:n]


def iter_records(stream: io.RawIOBase, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offsets and contents of the gzip members of a stream."""
    at, have = 0, b""
    while have or (have := stream.read(block)):
        z = zlib.decompressobj(31)
        parts, used, start = [], 0, at
        while not z.eof:
            if not have and not (have := stream.read(block)):
                raise EOFError("an archive ends inside a record")
            parts.append(z.decompress(have))
            used += len(have) - len(z.unused_data)
            have = z.unused_data
        at += used
        yield start, b"".join(parts)


# --------------------------------------------------------------------- writing


def _numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with ``row``, a number that is the same each time they are read.

    Files are always scanned alike; anything else is written first.
    """
    p = pages.select("page_id", "url", "html")
    if pages._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        p = staging.stage(p, "warc-pages")
    return p.withColumn("row", F.monotonically_increasing_id())


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each page with the page whose response it repeats (null: none).

    Only the digests of payloads that occur again are joined back, so the
    join has few rows on one side; its other side can be split where one
    payload is very frequent.
    """
    p = _numbered(pages).select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"), "row")
    p = p.withColumns({"sha": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    p = p.withColumn("key", F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("id"), "row"))
    owners = (
        p.filter(F.col("size") >= min_bytes).groupBy(F.col("sha").alias("o_sha")).agg(F.max("key").alias("o_key"), F.max("page_id").alias("o_page"), F.count("*").alias("n")).filter("n > 1").select("o_sha", "o_key", "o_page")
    )
    return p.join(owners, (p.sha == owners.o_sha) & (p["size"] >= min_bytes), "left").select("page_id", "url", "html", "key", F.when((F.col("o_key") != F.col("key")) & ~F.coalesce(F.col("page_id") == F.col("o_page"), F.lit(False)), F.col("o_key")).alias("o_key"), "o_page")


def write_warcs(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives to ``folder``; a row per archive, once computed.

    Archives are named by partition and replaced whole, so a task that runs
    again leaves one archive with the same records.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with files.replacing(f"{folder}/{name}") as out:
            for b in batches:
                for page, url, html, key, owner, owner_page in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                    full = f"{key['id']}:{key['row']}"
                    out.write(capture(page, full, url, html, payload_digest(html), owner and f"{owner['id']}:{owner['row']}", owner_page))
                    n += 3
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    return plan_records(pages, min_bytes).mapInArrow(write, WRITTEN)


# --------------------------------------------------------------------- reading


def read_warcs(spark: SparkSession, folder: str, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that ``archives`` names.

    Digests and lengths of response payloads are computed from the bytes
    read; ``payloads=False`` leaves the bytes themselves out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows, size = [], 0
                with files.reading(f"{folder}/{name}") as f:
                    for offset, raw in iter_records(f):
                        h, block = parse_record(raw)
                        kind = h["WARC-Type"]
                        page = h.get("X-Page-Id", "")
                        row = {"record_id": h["WARC-Record-ID"], "concurrent_to": h.get("WARC-Concurrent-To"), "kind": kind, "url": h.get("WARC-Target-URI"), "page_id": int(page) if page else None, "archive": name, "offset": offset}
                        row["declared_digest"] = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                        row["refers_to_id"] = h.get("WARC-Refers-To")
                        row["fields"] = list({k: v for k, v in h.items() if not k.startswith("WARC-")}.items())
                        if kind in ("response", "revisit"):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            row["declared_bytes"] = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            if kind == "response":
                                row |= {"payload_bytes": len(payload), "payload_digest": payload_digest(payload), "payload": payload if payloads else None}
                        else:
                            row["fields"] += [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x] if kind == "metadata" else [("request", block.split(b"\r\n")[0].decode())]
                        rows.append(row)
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))
    return archives.select("archive").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Every record is sent to the identifier of its capture, its own or the one
    it is concurrent to; a capture has few records, so one aggregation joins
    them.  Revisits then find their response by record id.
    """
    r = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    main = F.col("kind").isin("response", "revisit")
    part = lambda kind: F.max_by(F.struct("record_id", "fields", "archive", "offset"), F.when(F.col("kind") == kind, F.col("record_id"))).alias(kind)
    body = F.struct("record_id", "kind", "url", "page_id", "declared_bytes", "declared_digest", "payload_bytes", "payload_digest", "refers_to_id", "archive", "offset", "payload")
    return r.groupBy("capture_id").agg(F.max_by(body, F.when(main, F.col("record_id"))).alias("capture"), part("request"), part("metadata")).filter("capture is not null")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Payload length, digest and page of every capture, revisits included."""
    c = captures.select("capture_id", "capture.*", "request", "metadata")
    wanted = c.filter("kind = 'revisit'").select(F.col("refers_to_id").alias("f_id")).distinct()
    said = c.filter("kind = 'response'").select(F.col("record_id").alias("f_id"), F.col("page_id").alias("f_page"), F.col("payload_bytes").alias("f_bytes"), F.col("payload_digest").alias("f_digest"))
    found = said.join(wanted, "f_id", "left_semi")
    return c.join(found, F.col("refers_to_id") == F.col("f_id"), "left").select(
        "capture_id",
        "page_id",
        "url",
        F.coalesce("payload_bytes", "f_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "f_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("f_page").alias("refers_to"),
        "request",
        "metadata",
        "archive",
        "offset",
    )


def captures(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and assembles captures."""
    staging.ship(spark)
    folder = staging.new_path(spark, "warc")
    files.make_folder(folder)
    archives = staging.stage(write_warcs(pages, folder), "warc-archives")
    dealt = archives.repartition(max(1, min(archives.count(), MOST_READERS)))  # a count, or Spark makes one task of so few rows
    records = staging.stage(read_warcs(spark, folder, dealt, payloads), "warc-records")
    return resolve_revisits(assemble(records))
