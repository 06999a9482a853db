"""Splits of partitions: their states, and the move of rows to children.

A row of the state table is a partition with ``status``, its ``children``'s
names and the names of those that have acknowledged.  Rows move by pages in
key order behind a cursor; a row that a child has already is left alone, so
a page can be moved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.functions.hashing import bucket
from lodekey.operators.points import insert_if_absent, keyset_page

QUEUED, STARTED, COMPLETED = "split_queued", "split_started", "split_completed"
STATES = "partition string, status string, children array<string>, acked array<string>"


class Conflicting(ValueError):
    """A partition that was begun with other options."""


def queue(states: DataFrame, stats: DataFrame, max_bytes: int, in_flight: DataFrame, fan_out: int) -> DataFrame:
    """``states`` with the partitions that are over their size, unless they have a state or a promotion under way."""
    over = stats.filter(F.col("bytes") > max_bytes).select("partition")
    new = over.join(states.select("partition"), "partition", "left_anti").join(in_flight.select("partition"), "partition", "left_anti")
    names = F.transform(F.sequence(F.lit(0), F.lit(fan_out - 1)), lambda n: F.concat(F.col("partition"), F.lit("."), n.cast("string")))
    return states.unionByName(new.select("partition", F.lit(QUEUED).alias("status"), names.alias("children"), F.array().cast("array<string>").alias("acked")))


def start(states: DataFrame, locked: DataFrame) -> DataFrame:
    """Queued splits begin, but for partitions with locks."""
    held = locked.select("partition", F.lit(True).alias("_held")).distinct()
    m = states.join(held, "partition", "left")
    return m.withColumn("status", F.when((F.col("status") == QUEUED) & F.col("_held").isNull(), STARTED).otherwise(F.col("status"))).drop("_held")


def acknowledge(states: DataFrame, acks: DataFrame) -> DataFrame:
    """Children (``partition``, ``child``) that hold all of their rows; the last completes the split."""
    new = acks.groupBy("partition").agg(F.collect_set("child").alias("_new"))
    m = states.join(new, "partition", "left")
    both = F.array_sort(F.array_intersect("children", F.array_union("acked", F.coalesce("_new", F.array().cast("array<string>")))))
    m = m.withColumn("acked", F.when(F.col("status") == STARTED, both).otherwise(F.col("acked"))).drop("_new")
    return m.withColumn("status", F.when((F.col("status") == STARTED) & (F.size("acked") == F.size("children")), COMPLETED).otherwise(F.col("status")))


def waiting(states: DataFrame) -> DataFrame:
    """Children that a started split still waits for."""
    return states.filter(F.col("status") == STARTED).select("partition", F.explode(F.array_except("children", "acked")).alias("child"))


def begin_child(options: dict, stored: dict | None) -> dict:
    """What a child is made with; made again it must be with the same."""
    if stored is not None and {k: stored[k] for k in options} != options:
        raise Conflicting("the child was begun with other options")
    return stored if stored is not None else options | {"cursor": None, "complete": False}


def move_page(parent: DataFrame, child: DataFrame, depth: int, fan_out: int, number: int, n: int, cursor: tuple[bytes, bytes] | None = None) -> tuple[DataFrame, tuple[bytes, bytes] | None]:
    """The child with its share of the parent's next ``n`` rows, and the cursor behind them (None: all moved)."""
    page = keyset_page(parent.filter(bucket(F.col("hk"), depth + 1, fan_out) == number), n, cursor)
    last = page.agg(F.max(F.struct("hk", "sk")).alias("k")).first()["k"]
    after = insert_if_absent(child, page.withColumn("_one", F.lit(0)), "_one")
    return after, None if last is None else (bytes(last["hk"]), bytes(last["sk"]))


def progress(items: DataFrame, child: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """Rows of each child number, and how many of them are in ``child`` already."""
    mine = items.select("hk", "sk", bucket(F.col("hk"), depth + 1, fan_out).alias("child"))
    moved = child.select("hk", "sk", F.lit(1).alias("there")).distinct()
    return mine.join(moved, ["hk", "sk"], "left").groupBy("child").agg(F.count("*").alias("n_items"), F.count("there").alias("moved"))
