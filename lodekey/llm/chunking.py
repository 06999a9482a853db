"""Document fingerprints from content-defined chunks.

A gear hash of the last 32 bytes says where a chunk may end: with a rare
pattern while the chunk is shorter than the normal size, with a more common
one beyond it, so sizes gather around the normal size.  No chunk is shorter
than the hash's reach or longer than a limit, the last one apart.  An
insertion or removal changes the chunks that it touches and no others.

A fingerprint is the set of its distinct chunks, each written as 48 bits of
digest and 16 of length, in order of digest.  Likeness is containment: the
bytes of a's chunks that b also has, over the bytes of all of a's chunks.

Defined results: null text is empty, with an empty fingerprint; an empty
set is wholly contained in an empty one, and not in another (0); equal texts
have equal fingerprints; rows of equal ``doc_id`` follow each other by text,
null ``doc_id`` comes last; a document alone is its own next; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import staging

REACH, MIN, NORMAL, MAX = 32, 32, 64, 256
RARE_BITS, COMMON_BITS = 7, 5  # NORMAL is 2^6
GROUPS_PER_PARTITION = 4
_NO_ID = -(2**63)

FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear_table() -> np.ndarray:
    """One 32-bit number per byte value, by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def gear_hashes(raw: bytes) -> np.ndarray:
    """At each byte the sum of gear numbers of the last 32, each shifted by its age."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # a window doubles by adding the one before it
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return h


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(raw)
    if n <= MIN:
        return [n] if n else []
    h = gear_hashes(raw)
    at = np.flatnonzero(h >> np.uint32(32 - COMMON_BITS) == 0)
    rare = (h[at] >> np.uint32(32 - RARE_BITS) == 0).tolist()
    ends, start = [], 0
    for end, is_rare in zip((at + 1).tolist(), rare, strict=True):
        while end - start > MAX:
            start += MAX
            ends.append(start)
        size = end - start
        if size >= MIN and (is_rare or size > NORMAL):
            ends.append(end)
            start = end
    while n - start > MAX:
        start += MAX
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(raw: bytes) -> dict[str, int]:
    out, start, view = {}, 0, memoryview(raw)
    for end in chunk_ends(raw):
        out[f"{xxhash.xxh64_intdigest(view[start:end]) >> 16:012x}{end - start:04x}"] = end - start
        start = end
    return out


def fingerprint(chunks: dict[str, int]) -> str:
    return "".join(sorted(chunks))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    if not a:
        return 0.0 if b else 1.0
    return sum(a[c] for c in a.keys() & b.keys()) / sum(a.values())


def in_groups(docs: DataFrame) -> DataFrame:
    """Rows in descending ``doc_id`` inside each partition, in whole groups.

    Ranges of ids are dealt to groups by approximate quantiles.  Each group
    also gets a copy of the first row of the next group (``extra``), the last
    group that of the first, so every row's next row is at hand.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    n = GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    group = F.size(F.filter(F.lit(cuts), lambda c: c > key)) if len(cuts) <= 64 else None
    if group is None:  # two levels of look-up keep the expression short
        width = int(len(cuts) ** 0.5) + 1
        tops = cuts[width - 1 :: width]
        parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        top = F.size(F.filter(F.lit(tops), lambda c: c > key))
        group = top * width + F.size(F.filter(F.coalesce(F.get(F.array(*map(F.lit, parts)), top), F.array().cast("array<bigint>")), lambda c: c > key))
    d = d.withColumn("g", group)
    firsts = d.groupBy("g").agg(F.max(key).alias("k")).orderBy("g").collect()  # a row per group
    if not firsts:
        return d.select("g", F.lit(False).alias("extra"), "doc_id", "text")
    to = {r["k"]: firsts[i - 1]["g"] for i, r in enumerate(firsts)}
    sent = F.map_from_arrays(F.lit(list(to)), F.lit(list(to.values())))[key]
    copies = F.array(F.struct(F.col("g"), F.lit(False).alias("extra")), F.struct(sent.alias("g"), F.lit(True).alias("extra")))
    rows = d.select("doc_id", "text", F.explode(F.filter(copies, lambda c: c["g"].isNotNull())).alias("c")).select(F.col("c.g").alias("g"), F.col("c.extra").alias("extra"), "doc_id", "text")
    return rows.repartition("g").sortWithinPartitions("g", "extra", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    staging.ship(docs.sparkSession)

    def pair(own: tuple, nxt: tuple) -> tuple:
        doc_id, text, chunks = own
        half = len(text) // 2
        edited = (text[: len(text) - half] + nxt[1][:half]).encode()
        changed = chunk_set(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), fingerprint(chunks), fingerprint(changed), containment(chunks, changed), containment(chunks, nxt[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FINGERPRINTED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out, size, held, group, ended = [], 0, None, None, False
        for b in batches:
            for g, extra, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group:
                    held, group, ended = None, g, False
                if ended:
                    continue
                row = (doc_id, text, chunk_set(text.encode()))
                if held is not None:
                    out.append(pair(held, row))
                    size += len(held[1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
                held, ended = row, extra
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return in_groups(docs).mapInArrow(run, FINGERPRINTED)
