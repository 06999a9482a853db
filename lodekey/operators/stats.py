"""Sizes by key, heavy keys, and split boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodekey.functions.keys import separator_column
from lodekey.schema import PROMOTION_SHARE
from lodekey.sources.written import written


def key_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("hk").agg(F.sum("est_row_bytes").alias("est_bytes"))


def merge_key_sizes(sizes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Sizes after changes (``hk``, ``delta``); none falls below zero."""
    all_ = sizes.select("hk", F.col("est_bytes").alias("b")).unionByName(deltas.select("hk", F.col("delta").alias("b")))
    return all_.groupBy("hk").agg(F.greatest(F.sum("b"), F.lit(0)).alias("est_bytes"))


def orphan_sizes(sizes: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes kept for keys that have no items."""
    return sizes.join(items.select("hk"), "hk", "left_anti")


def heavy_keys(sizes: DataFrame, max_size_bytes: int) -> DataFrame:
    """Keys large enough for a range tree of their own."""
    return sizes.filter(F.col("est_bytes") >= F.lit(max_size_bytes * PROMOTION_SHARE))


def bounded_count(items: DataFrame, n: int) -> DataFrame:
    """Items of each hash key, counted up to ``n``; each task reads on no further for a key."""
    some = items.select("hk", "sk").withColumn("_n", F.row_number().over(Window.partitionBy("hk").orderBy("sk"))).filter(F.col("_n") <= n)
    return some.groupBy("hk").agg(F.count("*").alias("n"))


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Running sum in each key by ``order``, without a key meeting in one task.

    Spark deals rows to ranges of (``key``, ``order``) by sampled bounds, so a
    frequent key is cut into many.  The ranges are written once with their
    number; rows get the sum inside their range, and that of the key's ranges
    before it.  ``order`` is unique in a key.
    """
    ranged = df.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sums = ranged.groupBy(key, "_range").agg(F.sum(value).alias("_s"))  # a row per range and key
    before = sums.select(key, "_range", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.sum(value).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(before, [key, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def split_boundaries(items: DataFrame, n: int, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """``boundaries`` that cut each key's slice into ``n`` parts of like bytes.

    A step is the key's whole size over ``n``.  The first row at which the sum
    reaches the threshold, and that has a predecessor, gives a boundary: the
    shortest key between the two.  The next threshold is that sum and a step,
    so boundaries are found one after the other: ``n - 1`` aggregations over
    all keys together.  Keys that yield fewer have null.
    """
    totals = items.groupBy("hk").agg((F.sum("est_row_bytes") / n).alias("step"))
    inside = items
    if start is not None:
        inside = inside.filter(F.col("sk") >= F.lit(start))
    if end is not None:
        inside = inside.filter(F.col("sk") < F.lit(end))
    rows = written(running_sum(inside.select("hk", "sk", "est_row_bytes"), "hk", "sk", "est_row_bytes", "acc").select("hk", "sk", "acc"), "sums")
    found = totals.join(rows.groupBy("hk").agg(F.min("sk").alias("first_sk")), "hk").select("hk", "step", F.col("step").alias("threshold"), "first_sk", F.array().cast("array<binary>").alias("cuts"))
    for _ in range(n - 1):
        hit = rows.join(found, "hk").filter((F.col("acc") >= F.col("threshold")) & (F.col("sk") > F.col("first_sk")))
        at = hit.groupBy("hk").agg(F.min(F.struct("acc", "sk")).alias("at"))
        below = rows.join(at, "hk").filter(F.col("sk") < F.col("at.sk")).groupBy("hk").agg(F.max("sk").alias("prev"), F.first("at").alias("at"))
        cut = below.select("hk", F.col("at.acc").alias("at_acc"), separator_column(F.col("prev"), F.col("at.sk")).alias("cut"), F.col("at.sk").alias("at_sk"))
        found = found.join(cut, "hk", "left").select(
            "hk",
            "step",
            (F.col("at_acc") + F.col("step")).alias("threshold"),
            F.coalesce("at_sk", "first_sk").alias("first_sk"),
            F.when(F.col("cut").isNotNull(), F.array_append("cuts", F.col("cut"))).otherwise(F.col("cuts")).alias("cuts"),
        )
    low = F.lit(start if start is not None else b"")
    good = (F.size("cuts") == n - 1) & (F.col("cuts")[0] > low if n > 1 else F.lit(True)) & (F.size(F.array_distinct("cuts")) == n - 1)
    return found.select("hk", F.when(good, F.col("cuts")).alias("boundaries"))


def children(boundaries: DataFrame, start: bytes = b"", end: bytes = b"") -> DataFrame:
    """Slices [start, end) that tile each key's range; no bytes is open."""
    b = boundaries.filter("boundaries is not null")
    starts, ends = F.concat(F.array(F.lit(start)), "boundaries"), F.concat("boundaries", F.array(F.lit(end)))
    return b.select("hk", F.posexplode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("child", "s")).select("hk", "child", "s.start", "s.end")
