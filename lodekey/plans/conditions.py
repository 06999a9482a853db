"""Write conditions, and checks of transaction requests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodekey.schema import MAX_TX_BYTES, MAX_TX_ITEMS

ITEM_EXISTS = {"type": "item_exists", "value": None}
ITEM_NOT_EXISTS = {"type": "item_not_exists", "value": None}


def attribute_equals(v: int) -> dict:
    return {"type": "attribute_equals", "value": v}


def holds(condition: Column, v: Column) -> Column:
    """One condition on an item; a null ``v`` is an absent item."""
    kind, value = condition["type"], condition["value"]
    return (
        F.when(kind == "item_exists", v.isNotNull())
        .when(kind == "item_not_exists", v.isNull())
        .when(kind == "attribute_equals", F.coalesce(v == value, F.lit(False)))
        .otherwise(F.raise_error(F.concat(F.lit("no such condition: "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    )


def first_failing(conditions: Column, v: Column) -> Column:
    """Index from 0 of the first condition that fails; null if all hold."""
    held = F.transform(F.coalesce(conditions, F.array().cast("array<struct<type:string,value:bigint>>")), lambda c: holds(c, v))
    at = F.array_position(held, F.lit(False))
    return F.when(at > 0, at - 1)


def evaluate(conditions: list[dict] | None, v: int | None) -> int | None:
    """``first_failing`` for one item."""
    for i, c in enumerate(conditions or ()):
        ok = {"item_exists": v is not None, "item_not_exists": v is None, "attribute_equals": v is not None and v == c.get("value")}[c["type"]]
        if not ok:
            return i
    return None


def _with_bytes(items: DataFrame) -> DataFrame:
    return items if "data_bin" in items.columns else items.withColumn("data_bin", F.lit(None).cast("binary"))


def invalid_operations(items: DataFrame) -> DataFrame:
    """Every breach in transaction requests: ``transaction_id`` and ``problem``.

    Request rows are transaction items with ``data_text`` or ``data_bin``; keys
    are compared as encoded bytes.
    """
    items = _with_bytes(items)
    has_data = F.col("data_text").isNotNull() | F.col("data_bin").isNotNull()
    conditions = F.coalesce(F.size("conditions"), F.lit(0))
    problem = (
        F.when((F.col("operation") == "put") & ~has_data, "put_without_data")
        .when(F.col("operation").isin("delete", "check") & has_data, "data_not_allowed")
        .when((F.col("operation") == "check") & (conditions <= 0), "check_without_condition")
        .when(~F.col("operation").isin("put", "delete", "check"), "unknown_operation")
    )
    rows = items.select("transaction_id", problem.alias("problem")).filter("problem is not null")
    twice = items.groupBy("transaction_id", "hk", "sk").agg(F.count("*").alias("n")).filter("n > 1").select("transaction_id", F.lit("duplicate_key").alias("problem"))
    whole = items.groupBy("transaction_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("data_bin"), F.octet_length("data_text"), F.lit(0))).alias("b"))
    many = whole.filter(F.col("n") > MAX_TX_ITEMS).select("transaction_id", F.lit("too_many_items").alias("problem"))
    large = whole.filter(F.col("b") > MAX_TX_BYTES).select("transaction_id", F.lit("payload_too_large").alias("problem"))
    return rows.unionByName(twice).unionByName(many).unionByName(large).distinct()


def request_fingerprint(items: DataFrame) -> DataFrame:
    """One digest per transaction that its items' order doesn't change.

    Presence is part of it: data of no length differs from no data, and kinds
    differ.  Conditions count as their JSON text.
    """
    one = F.sha2(F.to_json(F.struct(F.hex("hk").alias("hk"), F.hex("sk").alias("sk"), "operation", (F.col("data_text").isNotNull() | F.col("data_bin").isNotNull()).alias("has_data"), "data_kind", F.hex("data_bin").alias("data_bin"), "data_text", F.to_json("conditions").alias("conditions")), {"ignoreNullFields": "false"}), 256)
    return _with_bytes(items).groupBy("transaction_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("operations_hash"))  # at most MAX_TX_ITEMS rows


def reason_json(reason: str, **details) -> str:
    """A rejection with its details; bytes are tagged."""
    return json.dumps({"type": reason, **{k: {"$u8": v.hex()} if isinstance(v, bytes) else v for k, v in details.items()}}, sort_keys=True)


def parse_reason(text: str) -> dict:
    return {k: bytes.fromhex(v["$u8"]) if isinstance(v, dict) and set(v) == {"$u8"} else v for k, v in json.loads(text).items()}
