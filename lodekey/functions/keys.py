"""Byte-ordered keys: strings as UTF-8, binary keys behind a byte FF."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = b"\xff"  # never occurs in UTF-8, so binary keys sort after all strings


class KeyError_(ValueError):
    """A key that can't be stored."""


def encode_key(value: str | bytes) -> bytes:
    if isinstance(value, str):
        if not value:
            raise KeyError_("a key can't be empty")
        try:
            return value.encode("utf-8")
        except UnicodeEncodeError:
            raise KeyError_("a key can't hold a lone surrogate") from None
    if not value:
        raise KeyError_("a key can't be empty")
    return MARK + bytes(value)


def encode_optional(value: str | bytes | None) -> bytes:
    """An absent sort key is no bytes: less than every other."""
    return b"" if value is None else encode_key(value)


def decode_key(key: bytes) -> str | bytes:
    return bytes(key[1:]) if key[:1] == MARK else key.decode("utf-8")


def decode_optional(key: bytes) -> str | bytes | None:
    return decode_key(key) if key else None


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with ``prefix``; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def shortest_separator(low: bytes, high: bytes) -> bytes:
    """Of the keys above ``low`` and not above ``high`` the one of fewest bytes that begins ``high``."""
    if not low < high:
        raise KeyError_("the lower key must be below the higher")
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), len(low))
    return high[: same + 1]


def check_key_text(value: str | bytes, most: int, what: str) -> bytes:
    """Encodes a key and holds it to the limits of the public interface."""
    if isinstance(value, str) and "\0" in value:
        raise KeyError_(f"a {what} can't hold NUL")
    key = encode_key(value)
    if len(key) > most:
        raise KeyError_(f"a {what} has at most {most} bytes")
    return key


def show_key(key: bytes) -> str:
    """For people: text as it is, binary in base64."""
    got = decode_optional(key)
    return "~absent" if got is None else got if isinstance(got, str) else "b64:" + base64.b64encode(got).decode()


def show_pair(hk: bytes, sk: bytes) -> str:
    return f"{show_key(hk)} / {show_key(sk)}"


# ---------------------------------------------------------------------- columns


def encode_text(c: Column) -> Column:
    return F.when(F.char_length(c) == 0, F.raise_error(F.lit("a key can't be empty"))).otherwise(F.encode(c, "UTF-8"))


def encode_binary(c: Column) -> Column:
    return F.when(F.octet_length(c) == 0, F.raise_error(F.lit("a key can't be empty"))).otherwise(F.concat(F.lit(MARK), c))


def optional(c: Column) -> Column:
    return F.coalesce(c, F.lit(b""))


def is_binary(key: Column) -> Column:
    return F.substring(key, 1, 1) == F.lit(MARK)


def decode_text(key: Column) -> Column:
    """The key's text; null for binary and absent keys."""
    return F.when((F.octet_length(key) > 0) & ~is_binary(key), F.decode(key, "UTF-8"))


def decode_binary(key: Column) -> Column:
    return F.when(is_binary(key), F.substring(key, 2, 1 << 30))


def successor_column(prefix: Column) -> Column:
    """As ``successor``; works on the hexadecimal digits."""
    body = F.regexp_replace(F.hex(prefix), "(FF)+$", "")
    last = F.conv(F.right(body, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(F.length(body) > 0, F.unhex(F.concat(F.left(body, F.length(body) - 2), F.lpad(F.hex(last), 2, "0"))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many bytes two keys begin with alike."""
    least = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))


def separator_column(low: Column, high: Column) -> Column:
    return F.substr(high, F.lit(1), common_prefix(low, high) + 1)


def show_column(key: Column) -> Column:
    """``show_key`` of a column; null stays null."""
    text = F.when(F.octet_length(key) == 0, F.lit("~absent")).when(is_binary(key), F.concat(F.lit("b64:"), F.base64(decode_binary(key))))
    return F.when(key.isNotNull(), F.coalesce(text, F.decode(key, "UTF-8")))


def show_pair_column(hk: Column, sk: Column) -> Column:
    return F.concat(show_column(hk), F.lit(" / "), show_column(sk))


def key_problem(key: Column, most: int) -> Column:
    """Why the public interface refuses a text as a key; null if it takes it."""
    return F.when(key.isNull() | (F.char_length(key) == 0), "empty").when(F.contains(key, F.lit("\0")), "holds_nul").when(F.octet_length(F.encode(key, "UTF-8")) > most, "too_long")
