"""Streams of operations: items kept in state, and published in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodekey.functions.sizes import row_bytes

APPLIED = "hk binary, sk binary, v long, last_transaction_ts long, data_text string, deleted boolean"
STATE = "v long, ts long, data_text string"


def apply_stream(ops: DataFrame) -> DataFrame:
    """Folds a stream of puts and deletes per key; a row per key and batch.

    Operations of one batch go in the order of ``seq``.  The state is an
    item's version, time and data; a delete removes it, and versions begin
    anew.  A late plain put still applies; the item's time never goes back.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, ts, data = state.get if state.exists else (0, 0, None)
        deleted, newest, live = None, None, []
        for f in frames:  # in any order; of each only the places and times of puts that still count are kept
            gone = f.seq[f.operation == "delete"]
            if len(gone):
                deleted = gone.max() if deleted is None else max(deleted, gone.max())
            puts = f[f.operation == "put"]
            puts = puts if deleted is None else puts[puts.seq > deleted]
            if len(puts):
                live.append(puts[["seq", "ts"]])
                last = puts.loc[puts.seq.idxmax()] if puts.seq.dtype != object else puts.sort_values("seq").iloc[-1]
                newest = last if newest is None or last.seq > newest.seq else newest
        if deleted is not None:
            v, ts, data = 0, 0, None
            live = [p[p.seq > deleted] for p in live]
        if n := sum(map(len, live)):
            v, ts, data = v + n, max(ts, *(int(p.ts.max()) for p in live if len(p))), newest.data_text
        if v:
            state.update((v, ts, data))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, v, ts, data, v == 0)], columns=["hk", "sk", "v", "last_transaction_ts", "data_text", "deleted"])

    rows = ops.select("hk", "sk", "seq", "operation", "ts", "data_text")
    return rows.groupBy("hk", "sk").applyInPandasWithState(step, APPLIED, STATE, "update", GroupStateTimeout.NoTimeout)


def watermark_stream(deletes: DataFrame) -> DataFrame:
    """Per partition the largest time of a delete so far."""
    return deletes.groupBy("partition_id").agg(F.max("ts").alias("max_deleted_ts"))


def once_per_token(requests: DataFrame, time: str = "requested_at", horizon: str | None = None) -> DataFrame:
    """The first request of each token.

    Tokens never expire unless ``horizon`` bounds the state; a repeat later
    than that goes through again.
    """
    if horizon is None:
        return requests.dropDuplicates(["token"])
    return requests.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["token"])


def publish_batches(ops: DataFrame, table, checkpoint: str, stream: str = "ops"):
    """A query that folds each batch into a stored table, once.

    The table's version holds the number of the stream's last batch, so one
    that is replayed after a failure changes nothing.
    """

    def publish(batch: DataFrame, n: int) -> None:
        if table.published(stream) >= n:
            return
        items = table.items()
        key = Window.partitionBy("hk", "sk").orderBy("seq")
        is_delete = F.col("operation") == "delete"
        if "data_bin" not in batch.columns:
            batch = batch.withColumn("data_bin", F.lit(None).cast("binary"))
        b = batch.withColumn("epoch", F.count(F.when(is_delete, 1)).over(key))
        data = F.max_by(F.struct("data_kind", "data_bin", "data_text"), "seq").alias("new")
        puts = b.filter(~is_delete).groupBy("hk", "sk", "epoch").agg(F.count("*").alias("n"), F.max("ts").alias("ts"), data)
        last = b.groupBy("hk", "sk").agg(F.max("epoch").alias("epochs"))
        new = last.join(puts, ["hk", "sk"], "left").filter("epoch is null or epoch = epochs")
        new = new.withColumn("n", F.coalesce("n", F.lit(0)))
        m = items.join(new, ["hk", "sk"], "full_outer")
        kept = F.col("epochs").isNull() | (F.col("epochs") == 0)
        changed = F.coalesce(F.col("n") > 0, F.lit(False))
        out = m.filter(F.col("epochs").isNull() | changed | (kept & F.col("v").isNotNull())).select(
            "hk",
            "sk",
            F.when(changed, F.col("new.data_kind")).otherwise(F.col("data_kind")).alias("data_kind"),
            (F.when(kept, F.coalesce("v", F.lit(0))).otherwise(0) + F.coalesce("n", F.lit(0))).alias("v"),
            F.when(kept, F.greatest("last_transaction_ts", "ts")).otherwise(F.col("ts")).alias("last_transaction_ts"),
            F.when(~changed, F.col("ttl_epoch_utc_seconds")).alias("ttl_epoch_utc_seconds"),
            F.when(changed, F.col("new.data_bin")).otherwise(F.col("data_bin")).alias("data_bin"),
            F.when(changed, F.col("new.data_text")).otherwise(F.col("data_text")).alias("data_text"),
        )
        table.publish(out.withColumn("est_row_bytes", row_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text"))), stream, n)

    return ops.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
