"""Exact similarity of texts, as sets of hashes of their word shingles.

Texts are read from archives by their place, so a text is never sent with its
pairs.

Defined results: null and blank texts have no shingle and are similar to each
other only; texts of fewer words than a shingle are one shingle; an empty
table gives no rows.
"""

from __future__ import annotations

import contextlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import files
from lodekey.llm.archives import ROW_BITS, archive, by_archive, texts_at
from lodekey.llm.shingles import shingle_hashes

KEPT_BYTES = 8 << 20  # of sets that a task keeps while it compares
SENT_BYTES = 1 << 20  # of sets in a batch


def shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


class _Sets:
    """Sets of texts by rid and place, the last used ones kept."""

    def __init__(self, folder: str, width: int, stack: contextlib.ExitStack):
        import zstandard

        self.folder, self.width, self.stack, self.unpack = folder, width, stack, zstandard.ZstdDecompressor()
        self.kept: OrderedDict = OrderedDict()
        self.opened: dict = {}
        self.bytes = 0

    def __call__(self, rid: int, at: int, packed: int) -> np.ndarray:
        if rid in self.kept:
            self.kept.move_to_end(rid)
            return self.kept[rid]
        task = rid >> ROW_BITS
        if task not in self.opened:
            if len(self.opened) > 50:
                self.stack.close()
                self.opened.clear()
            self.opened[task] = self.stack.enter_context(files.reading(archive(self.folder, task)))
        self.opened[task].seek(at)
        made = shingles(self.unpack.decompress(self.opened[task].read(packed)).decode(), self.width)
        self.kept[rid] = made
        self.bytes += made.nbytes
        while self.bytes > KEPT_BYTES and len(self.kept) > 2:
            self.bytes -= self.kept.popitem(last=False)[1].nbytes
        return made


def sets(nodes: DataFrame, places: DataFrame, folder: str, width: int) -> DataFrame:
    """``node``, ``size`` and ``set`` of the texts of ``nodes``; ``places`` as for ``verified``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in ("rid", "at", "packed")), strict=True)
            out, start, size = [], 0, 0
            for i, t in enumerate(texts_at(folder, places)):
                out.append(shingles(t.decode(), width).view(np.int64))
                size += out[-1].nbytes
                if size > SENT_BYTES or i + 1 == b.num_rows:
                    bounds = np.cumsum([0, *map(len, out)]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([b.column("rid").slice(start, len(out)), pa.array(np.diff(bounds)), listed], names=["node", "size", "set"])
                    out, start, size = [], i + 1, 0

    found = nodes.join(places.filter("packed >= 0"), "node").withColumnRenamed("node", "rid")  # null texts have no shingle
    return by_archive(found).select("rid", "at", "packed").mapInArrow(run, "node long, size int, set array<long>")


def verified(pairs: DataFrame, places: DataFrame, folder: str, least: float, width: int) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) whose sets are similar enough; ``places`` has ``node``, ``at`` and ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            read = _Sets(folder, width, stack)
            for b in batches:
                u, v, *where = (b.column(i).to_pylist() for i in range(6))
                same = [similarity(read(x, *p[:2]), read(y, *p[2:])) >= least for x, y, *p in zip(u, v, *where, strict=True)]
                yield b.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    at = lambda x: places.select(F.col("node").alias(x), F.col("at").alias(f"{x}_at"), F.col("packed").alias(f"{x}_packed"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count: pairs are small, but costly to compare, so few tasks won't do
    dealt = pairs.join(at("u"), "u").join(at("v"), "v").repartition(n, "u", "v").sortWithinPartitions("u", "v")
    return dealt.select("u", "v", "u_at", "u_packed", "v_at", "v_packed").mapInArrow(run, "u long, v long")
