"""Texts kept compressed in archives, one per task, and read again by their place.

So a text is never shuffled.  A row's number ``rid`` packs the number of the
task (each attempt has an archive of its own) and that of the row in it; a
text's place is where it begins, ``at``, and its size ``packed`` there.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import files

ROW_BITS = 33
STRIPE_BITS = 22  # of an archive, that one task reads at a time


def archive(folder: str, task: int) -> str:
    return f"{folder}/part-{task:06d}.texts"


def texts_at(folder: str, rows: Iterator[tuple[int, int, int]]) -> Iterator[bytes]:
    """Texts by rid and place; each archive stays open while it is used."""
    import zstandard

    unpack, now = zstandard.ZstdDecompressor(), None
    with contextlib.ExitStack() as stack:
        for rid, at, packed in rows:
            if rid >> ROW_BITS != now:
                stack.close()
                now = rid >> ROW_BITS
                f = stack.enter_context(files.reading(archive(folder, now)))
            f.seek(at)
            yield unpack.decompress(f.read(packed))


def by_archive(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks by stripes of their archive, in its order."""
    near = df.withColumns({"_task": F.shiftright("rid", ROW_BITS), "_near": F.shiftright("at", STRIPE_BITS)})
    return near.repartition("_task", "_near").sortWithinPartitions("_task", "at").drop("_task", "_near")
