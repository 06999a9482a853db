"""Driver tables as items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekey.functions import sizes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "UTF-8")


def padded(c: Column | str, n: int) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), n, "0")


def as_items(df: DataFrame, hk: Column, sk: Column, text: Column, kind: int = 1) -> DataFrame:
    d = df.select(hk.alias("hk"), sk.alias("sk"), text.alias("data_text"))
    return d.select(
        "hk",
        "sk",
        F.lit(kind).alias("data_kind"),
        F.lit(1).cast("long").alias("v"),
        F.lit(0).cast("long").alias("last_transaction_ts"),
        F.lit(None).cast("long").alias("ttl_epoch_utc_seconds"),
        sizes.row_bytes(F.col("hk"), F.col("sk"), F.lit(None).cast("binary"), F.col("data_text")).alias("est_row_bytes"),
        F.lit(None).cast("binary").alias("data_bin"),
        "data_text",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by date."""
    sk = key("order#", F.date_format("o_orderdate", "yyyy-MM-dd"), "#", padded("o_orderkey", 10))
    return as_items(table(spark, sf_dir, "orders"), key("cust#", F.col("o_custkey").cast("string")), sk, F.col("o_orderpriority"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(table(spark, sf_dir, "conversations"), key("conv#", F.col("conv_id").cast("string")), key(padded("turn", 6)), F.col("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(table(spark, sf_dir, "documents"), key(F.col("lang")), key(padded("doc_id", 10)), F.col("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = key(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return as_items(table(spark, sf_dir, "events"), key("user#", F.col("user_id").cast("string")), sk, F.col("props"), 2)


def line_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as puts; several share a key, and ``seq`` puts them in order."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(
        key("ord#", F.col("l_orderkey").cast("string")).alias("hk"),
        key(padded("l_linenumber", 4)).alias("sk"),
        F.struct(*order).alias("seq"),
        F.lit("put").alias("operation"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.lit(1).alias("data_kind"),
        F.lit(None).cast("binary").alias("data_bin"),
        F.col("l_returnflag").alias("data_text"),
    )


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: an item per user, errors delete it, all else puts."""
    return table(spark, sf_dir, "events").select(
        key("user#", F.col("user_id").cast("string")).alias("hk"),
        F.lit(b"").alias("sk"),
        F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("operation"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit(2).alias("data_kind"),
        F.lit(None).cast("binary").alias("data_bin"),
        F.col("props").alias("data_text"),
        "event_id",
        "event_type",
        (F.col("user_id") % 7).cast("int").alias("partition_id"),
    )
