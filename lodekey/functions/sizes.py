"""The two measures of a row's size, and checks of item data."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodekey.schema import KINDS, MAX_ITEM_UNITS, PAGE_ROW_OVERHEAD, ROW_OVERHEAD


def data_octets(data_bin: Column, data_text: Column) -> Column:
    return F.coalesce(F.octet_length(data_bin), F.octet_length(data_text), F.lit(0)).cast("long")


def row_bytes(hk: Column, sk: Column, data_bin: Column, data_text: Column) -> Column:
    """Decides on splits and promotions."""
    return data_octets(data_bin, data_text) + F.octet_length(hk) + F.octet_length(sk) + ROW_OVERHEAD


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def page_bytes(hk: Column, sk: Column, data_bin: Column, data_text: Column) -> Column:
    """Counts against the byte budget of a page."""
    data = F.coalesce(F.octet_length(data_bin).cast("long"), F.octet_length(F.encode(data_text, "UTF-16BE")).cast("long"), F.lit(0))
    return data + F.octet_length(hk) + F.octet_length(sk) + PAGE_ROW_OVERHEAD


def pending_bytes(hk: Column, sk: Column, data_bin: Column, data_text: Column, conditions_json: Column) -> Column:
    return page_bytes(hk, sk, data_bin, data_text) + 2 * F.coalesce(utf16_units(conditions_json), F.lit(0))


def encode_data(value: str | bytes | dict | list) -> tuple[int, bytes | None, str | None]:
    """Kind code, bytes and text of a value; JSON is objects and lists only."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        kind, raw, text, units = "bytes", bytes(value), None, len(value)
    elif isinstance(value, str):
        kind, raw, text, units = "text", None, value, len(value.encode("utf-16-be", "surrogatepass")) // 2
    elif isinstance(value, (dict, list, tuple)):
        text = json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
        kind, raw, units = "json", None, len(text.encode("utf-16-be", "surrogatepass")) // 2
    else:
        raise ValueError("data is bytes, text, or a JSON object or array")
    if units > MAX_ITEM_UNITS:
        raise ValueError(f"data has at most {MAX_ITEM_UNITS} bytes")
    return KINDS.index(kind), raw, text


def decode_data(kind: int, raw: bytes | None, text: str | None):
    return (raw, text, None)[kind] if kind < 2 else json.loads(text)


def kind_of(text: Column) -> Column:
    """json for text that parses to an object or array, else text."""
    parsed = F.try_parse_json(text)
    top = F.schema_of_variant(parsed)
    return F.when(top.startswith("OBJECT") | top.startswith("ARRAY"), KINDS.index("json")).otherwise(KINDS.index("text"))


def shown_data(data_kind: Column, data_bin: Column, data_text: Column) -> Column:
    """Data as JSON with how it is written: utf8, base64 or json."""
    return F.when(data_kind == 0, F.to_json(F.struct(F.lit("base64").alias("encoding"), F.base64(data_bin).alias("data")))).when(data_kind == 1, F.to_json(F.struct(F.lit("utf8").alias("encoding"), data_text.alias("data")))).otherwise(F.to_json(F.struct(F.lit("json").alias("encoding"), data_text.alias("data"))))
