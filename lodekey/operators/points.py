"""Point operations on sets of keys: get, put, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodekey.functions import sizes
from lodekey.plans.conditions import first_failing


def batch_get(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Each requested key (all columns of ``keys`` stay) with its item, if found."""
    hits = items.join(keys.select("hk", "sk").distinct(), ["hk", "sk"])
    return keys.join(hits, ["hk", "sk"], "left").withColumn("found", F.col("v").isNotNull())


def get_stamps(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Versions and timestamps only, so the scan reads no data."""
    return batch_get(items.select("hk", "sk", "v", "last_transaction_ts"), keys)


def keyset_page(items: DataFrame, n: int, after: tuple[bytes, bytes] | None = None) -> DataFrame:
    """The next ``n`` items of the table in key order."""
    if after is not None:
        hk, sk = F.lit(after[0]), F.lit(after[1])
        items = items.filter((F.col("hk") >= hk) & ((F.col("hk") > hk) | (F.col("sk") > sk)))
    return items.orderBy("hk", "sk").limit(n)


def slice_page(items: DataFrame, hk: bytes, interval, n: int, forward: bool = True) -> DataFrame:
    """The next ``n`` items of one hash key inside an interval."""
    order = F.col("sk").asc() if forward else F.col("sk").desc()
    return items.filter((F.col("hk") == F.lit(hk)) & interval.column(F.col("sk"))).orderBy(order).limit(n)


def conditional_puts(items: DataFrame, puts: DataFrame) -> DataFrame:
    """What one put per key does: ``version``, and ``failed``, the condition's index.

    ``puts`` has a row per key with ``conditions`` and ``ts``.
    """
    now = items.select("hk", "sk", F.col("v").alias("old_v"), F.col("last_transaction_ts").alias("old_ts"))
    m = puts.join(now, ["hk", "sk"], "left").withColumn("failed", first_failing(F.col("conditions"), F.col("old_v")))
    ok = F.col("failed").isNull()
    return m.withColumns({"version": F.when(ok, F.coalesce(F.col("old_v"), F.lit(0)) + 1), "new_ts": F.when(ok, F.greatest(F.col("ts"), F.col("old_ts")))})


def apply_puts(items: DataFrame, outcome: DataFrame) -> DataFrame:
    """The table after ``conditional_puts``: data and time to live are overwritten."""
    done = outcome.filter("failed is null")
    fresh = done.select("hk", "sk", "data_kind", F.col("version").alias("v"), F.col("new_ts").alias("last_transaction_ts"), F.lit(None).cast("long").alias("ttl_epoch_utc_seconds"), sizes.row_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text")).alias("est_row_bytes"), "data_bin", "data_text")
    return items.join(done.select("hk", "sk"), ["hk", "sk"], "left_anti").unionByName(fresh)


def conditional_deletes(items: DataFrame, keys: DataFrame) -> DataFrame:
    """``deleted`` and ``failed`` for one delete per key with ``conditions``."""
    m = keys.join(items.select("hk", "sk", "v"), ["hk", "sk"], "left").withColumn("failed", first_failing(F.col("conditions"), F.col("v")))
    return m.withColumn("deleted", F.col("failed").isNull() & F.col("v").isNotNull())


def apply_deletes(items: DataFrame, outcome: DataFrame) -> DataFrame:
    return items.join(outcome.filter("deleted").select("hk", "sk"), ["hk", "sk"], "left_anti")


def insert_if_absent(items: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Adds items whose key isn't there; of several with one key the first."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("hk", "sk").orderBy(order))).filter("_n = 1").drop("_n", order)
    return items.unionByName(first.join(items.select("hk", "sk"), ["hk", "sk"], "left_anti"))


def bounded_delete(items: DataFrame, hash_keys: DataFrame, n: int = 1000) -> DataFrame:
    """The table without the first ``n`` items of each listed hash key."""
    listed = items.join(hash_keys.select("hk").distinct(), "hk", "left_semi").select("hk", "sk")
    gone = listed.withColumn("_n", F.row_number().over(Window.partitionBy("hk").orderBy("sk"))).filter(F.col("_n") <= n)
    return items.join(gone.select("hk", "sk"), ["hk", "sk"], "left_anti")


def has_items(items: DataFrame, hk: bytes) -> bool:
    return not items.filter(F.col("hk") == F.lit(hk)).select("sk").isEmpty()
