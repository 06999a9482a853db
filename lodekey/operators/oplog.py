"""Folding logs of puts and deletes into items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodekey.plans.conditions import evaluate


def with_epochs(ops: DataFrame) -> DataFrame:
    """Each operation with its delete epoch and its version in it.

    A delete opens the next epoch, and versions begin anew; ``v`` is the
    version that a put makes, and of a delete null.
    """
    key = Window.partitionBy("hk", "sk").orderBy("seq")
    is_delete = F.col("operation") == "delete"
    e = ops.withColumn("epoch", F.count(F.when(is_delete, 1)).over(key))
    inside = Window.partitionBy("hk", "sk", "epoch").orderBy("seq")
    return e.withColumn("v", F.when(~is_delete, F.count(F.when(F.col("operation") == "put", 1)).over(inside)))


def fold(ops: DataFrame) -> DataFrame:
    """Items that unconditional puts and deletes leave, by aggregation only.

    The log is combined before it is shuffled: first puts per key since its
    last delete, then their number, the latest data and the largest time.
    """
    last = ops.groupBy("hk", "sk").agg(F.max(F.when(F.col("operation") == "delete", F.col("seq"))).alias("last_delete"))
    live = ops.filter("operation = 'put'").join(last, ["hk", "sk"]).filter("last_delete is null or seq > last_delete")
    data = F.max_by(F.struct("data_kind", "data_bin", "data_text"), "seq").alias("data")
    return live.groupBy("hk", "sk").agg(F.count("*").alias("v"), F.max("ts").alias("last_transaction_ts"), data).select("hk", "sk", "v", "last_transaction_ts", "data.*")


def deletion_watermarks(ops: DataFrame, partition: str = "partition_id") -> DataFrame:
    """Per partition the largest time of a delete that removed an item."""
    key = Window.partitionBy("hk", "sk").orderBy("seq")
    before = F.lag("operation").over(key)
    removed = ops.withColumn("removed", (F.col("operation") == "delete") & F.coalesce(before == "put", F.lit(False)))
    return removed.filter("removed").groupBy(partition).agg(F.max("ts").alias("max_deleted_ts"))


OUTCOME = "hk binary, sk binary, seq bigint, accepted boolean, failed int, v bigint"


def fold_conditional(ops: DataFrame) -> DataFrame:
    """Outcome of each operation of a log with conditions, in its order.

    Whether one is accepted depends on those before it, so each key's rows
    are walked in order; they are streamed, not gathered, so a key's log may
    be of any length.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, v = None, None
        for f in frames:
            out = []
            for hk, sk, seq, operation, conditions in zip(f.hk, f.sk, f.seq, f.operation, f.conditions, strict=True):
                if (hk, sk) != key:
                    key, v = (hk, sk), None
                listed = [] if conditions is None else [{"type": c["type"], "value": None if pd.isna(c["value"]) else int(c["value"])} for c in conditions]
                failed = evaluate(listed, v)
                if failed is None:
                    v = {"put": (v or 0) + 1, "delete": None}.get(operation, v)
                out.append((hk, sk, seq, failed is None, failed, v))
            got = pd.DataFrame(out, columns=["hk", "sk", "seq", "accepted", "failed", "v"])
            yield got.astype({"failed": "Int32", "v": "Int64"})

    rows = ops.select("hk", "sk", "seq", "operation", "conditions").repartition("hk", "sk").sortWithinPartitions("hk", "sk", "seq")
    return rows.mapInPandas(walk, OUTCOME)
