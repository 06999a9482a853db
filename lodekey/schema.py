"""Schemas of the item model and the limits that inputs are held to."""

from __future__ import annotations

from pyspark.sql import types as T

_CONDITIONS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.LongType())]))


def _struct(required: int = 0, **fields: T.DataType) -> T.StructType:
    """The first ``required`` fields are never null."""
    return T.StructType([T.StructField(k, t, i >= required) for i, (k, t) in enumerate(fields.items())])


ITEM = _struct(
    2,
    hk=T.BinaryType(),
    sk=T.BinaryType(),  # absent: no bytes
    data_kind=T.IntegerType(),
    v=T.LongType(),
    last_transaction_ts=T.LongType(),
    ttl_epoch_utc_seconds=T.LongType(),
    est_row_bytes=T.LongType(),
    data_bin=T.BinaryType(),
    data_text=T.StringType(),
)
OPERATION = _struct(seq=T.LongType(), hk=T.BinaryType(), sk=T.BinaryType(), operation=T.StringType(), ts=T.LongType(), data_kind=T.IntegerType(), data_bin=T.BinaryType(), data_text=T.StringType(), conditions=_CONDITIONS)
PENDING = _struct(hk=T.BinaryType(), sk=T.BinaryType(), transaction_id=T.StringType(), transaction_ts=T.LongType(), created_at=T.LongType(), operation=T.StringType(), data_kind=T.IntegerType(), data_bin=T.BinaryType(), data_text=T.StringType())
TX_ITEM = _struct(
    transaction_id=T.StringType(),
    transaction_ts=T.LongType(),
    ordinal=T.IntegerType(),
    partition_id=T.StringType(),
    hk=T.BinaryType(),
    sk=T.BinaryType(),
    operation=T.StringType(),
    data_kind=T.IntegerType(),
    data_text=T.StringType(),
    conditions=_CONDITIONS,
    data_bin=T.BinaryType(),
)

# Kinds by code, in this order.
KINDS = ("bytes", "text", "json")
# Limits.
MAX_HASH_KEY_BYTES = 1024
MAX_SORT_KEY_BYTES = 512
MAX_ITEM_UNITS = 400 * 1024
MAX_TX_ITEMS = 100
MAX_TX_BYTES = 4 * 1024 * 1024
DEFAULT_PAGE_BYTES = 3 * 1024 * 1024
MAX_PAGE_BYTES = 16 * 1024 * 1024
MAX_PAGE_VISITS = 100
MAX_CLOCK_SKEW_MS = 5000
STALE_LOCK_MS = 5000
ROW_OVERHEAD = 100
PAGE_ROW_OVERHEAD = 72
SPLIT_SLACK = 1.1
PROMOTION_SHARE = 0.25
# Rejection reasons.
REASONS = ("condition_failed", "timestamp_conflict", "pending_conflict", "clock_skew", "transient_error")
