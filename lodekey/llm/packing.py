"""Best-fit packing of token sequences by the counts of their lengths.

Items over a third of the capacity are large: at most two of them share a
bin, and a greedy match gives each, longest first, the longest partner that
still fits.  Smaller items, longest first, go to the bin with the tightest
gap that takes them.  Items of one length are alike, so the plan works on
the number of items of each length: it is made on the driver from at most
``capacity`` counts, however many documents there are, and its size depends
on the number of lengths, not of documents.  Bins filled alike are planned
as one group.

Applying the plan numbers the items of each length without gaps (counts per
length and block, a running sum over those, a row number inside a block) and
looks the place of each number up.

Defined results: null text is empty; an empty document is its end token;
ties and repeated rows are items of their own; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodekey.llm import staging, wordtokens

CAPACITY = 4096
END_ID = 1
BLOCK_ROWS = 2_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids cut into pieces of at most ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordtokens.shared(vocabulary)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), 1000):
                rows: list = []
                for key, ids in zip(keys[i : i + 1000], encoder.encode(texts[i : i + 1000]), strict=True):
                    raw = memoryview(ids + end)
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


class _Group:
    """``n`` bins filled alike; ``items`` lists (length, first rank)."""

    __slots__ = ("items", "n")

    def __init__(self, n: int, items: list[tuple[int, int]]):
        self.n, self.items = n, items

    def split(self, n: int) -> _Group:
        """Takes the first ``n`` bins out."""
        taken = _Group(n, list(self.items))
        self.items = [(length, rank + n) for length, rank in self.items]
        self.n -= n
        return taken


class Plan:
    """Places by (length, rank): the first rank, sequence and offset of each run."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.groups = capacity, []
        self.used = dict.fromkeys(counts, 0)
        self.left = dict(counts)
        self.open: dict[int, list[_Group]] = {}  # by gap
        self.gaps: list[int] = []
        self._large()
        self._small()
        for gap in list(self.open):
            self.groups += self.open[gap]
        self._number()

    def _take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return first

    def _keep(self, group: _Group, gap: int) -> None:
        if gap == 0:
            self.groups.append(group)
            return
        if gap not in self.open:
            self.open[gap] = []
            bisect.insort(self.gaps, gap)
        self.open[gap].append(group)

    def _large(self) -> None:
        sizes = sorted(s for s in self.left if 3 * s > self.capacity)
        for size in reversed(sizes):
            while self.left[size]:
                at = bisect.bisect_right(sizes, min(size, self.capacity - size)) - 1
                while at >= 0 and not self.left[sizes[at]]:
                    at -= 1
                if at < 0:
                    n = self.left[size]
                    self._keep(_Group(n, [(size, self._take(size, n))]), self.capacity - size)
                    break
                other = sizes[at]
                n = min(self.left[size], self.left[other]) if other != size else self.left[size] // 2
                if not n:  # one item of this length is left and would only match itself
                    smaller = next((s for s in reversed(sizes[:at]) if self.left[s]), None)
                    items = [(size, self._take(size, 1))]
                    if smaller is not None:
                        items.append((smaller, self._take(smaller, 1)))
                    self._keep(_Group(1, items), self.capacity - sum(s for s, _ in items))
                    break
                items = [(size, self._take(size, n)), (other, self._take(other, n))]
                self._keep(_Group(n, items), self.capacity - size - other)

    def _small(self) -> None:
        for size in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            while n := self.left[size]:
                at = bisect.bisect_left(self.gaps, size)
                if at == len(self.gaps):
                    most = self.capacity // size
                    bins, gap = max(1, n // most), self.capacity
                    group = _Group(bins, [])
                else:
                    gap = self.gaps[at]
                    most = gap // size
                    group = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                each = min(most, n)
                bins = min(group.n, n // each)
                if bins < group.n:
                    rest, group = group, group.split(bins)
                    self._keep(rest, gap)
                for _ in range(each):
                    group.items.append((size, self._take(size, bins)))
                self._keep(group, gap - each * size)

    def _number(self) -> None:
        runs, self.sequences = [], 0
        for g in self.groups:
            offset = 0
            for length, rank in g.items:
                runs.append((length, rank, self.sequences, offset))
                offset += length
            self.sequences += g.n
        table = np.array(sorted(runs), np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = table.T

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of items by length and number among its like."""
        first = np.searchsorted(self.length, length, "left")
        stop = np.searchsorted(self.length, length, "right")
        while True:  # all searches at once
            wide = stop - first > 1
            if not wide.any():
                break
            mid = (first + stop) // 2
            up = wide & (self.rank[mid.clip(max=len(self.rank) - 1)] <= rank)
            first, stop = np.where(up, mid, first), np.where(wide & ~up, mid, stop)
        return self.sequence[first] + rank - self.rank[first], self.offset[first]


def number_within(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """Numbers rows from 0 without gaps within each key, a few per task.

    Rows of a key are dealt to blocks of about ``BLOCK_ROWS`` by a hash of
    their order columns; blocks get running offsets from their counts.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    dealt = df.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(*order), "_blocks")).drop("_blocks")
    counts = dealt.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = Window.partitionBy(key, "_block").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inner))
    return numbered.join(offsets, [key, "_block"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_before", "_row", "_block")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``."""
    spark = pieces.sparkSession
    pieces = staging.stage(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    ranked = number_within(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.places(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    staging.ship(docs.sparkSession)
    return pack(tokenized_pieces(docs, vocabulary, capacity), capacity)
