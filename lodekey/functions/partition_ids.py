"""Identities of partitions: packed bytes, shown as hexadecimal digits, and names.

A hash partition is a root and the way of child numbers below it.  A range
partition is a hash key and its slice [start, end), open where a bound is
absent.  Both pack into bytes whose first is the layout.  Names are for
people and folders; they are made from the packed form and never read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layouts by their first byte, and flags of bounds that are there.
HASH_LAYOUT, RANGE_LAYOUT = 0, 1
HAS_START, HAS_END = 1, 2
# Bytes that names hold as they are are 21 to 7D but for these; open ends.
ESCAPED = (0x22, 0x25, 0x2E, 0x5C)
OPEN_START, OPEN_END = "~min", "~max"


@dataclass(frozen=True)
class HashPartition:
    root: int
    path: tuple[int, ...] = ()

    def pack(self) -> bytes:
        return bytes([HASH_LAYOUT]) + self.root.to_bytes(2, "big") + bytes([len(self.path), *self.path])

    def child(self, n: int) -> HashPartition:
        return HashPartition(self.root, (*self.path, n))

    def children(self, fan_out: int) -> list[HashPartition]:
        return [self.child(n) for n in range(fan_out)]

    def name(self, table: str) -> str:
        return ".".join([table, "h", str(self.root), *map(str, self.path)])


@dataclass(frozen=True)
class RangePartition:
    hk: bytes
    start: bytes | None = None
    end: bytes | None = None

    def pack(self) -> bytes:
        flags = HAS_START * (self.start is not None) + HAS_END * (self.end is not None)
        start, end = self.start or b"", self.end or b""
        return bytes([RANGE_LAYOUT, flags]) + len(self.hk).to_bytes(4, "little") + len(start).to_bytes(4, "little") + self.hk + start + end

    def name(self, table: str) -> str:
        return ".".join([table, "r", name_part(self.hk), OPEN_START if self.start is None else name_part(self.start), OPEN_END if self.end is None else name_part(self.end)])


def unpack(raw: bytes) -> HashPartition | RangePartition:
    if raw[:1] == bytes([HASH_LAYOUT]) and len(raw) >= 4 and len(raw) == 4 + raw[3]:
        return HashPartition(int.from_bytes(raw[1:3], "big"), tuple(raw[4:]))
    if raw[:1] == bytes([RANGE_LAYOUT]) and len(raw) >= 10:
        a = 10 + int.from_bytes(raw[2:6], "little")
        b = a + int.from_bytes(raw[6:10], "little")
        return RangePartition(raw[10:a], raw[a:b] if raw[1] & HAS_START else None, raw[b:] if raw[1] & HAS_END else None)
    raise ValueError("not the identity of a partition")


def name_part(key: bytes) -> str:
    """A key inside a name: what isn't plain is written as % and two digits."""
    return "".join(chr(b) if 0x21 <= b <= 0x7D and b not in ESCAPED else f"%{b:02X}" for b in key)


# ---------------------------------------------------------------------- columns


def _digits(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n.cast("long"))), width, "0")


def _little(n: Column) -> Column:
    """Four bytes, the least first, as digits."""
    return F.concat(*[_digits(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(F.lit(255)), 2) for i in range(4)])


def hash_id(root: Column, path: Column) -> Column:
    """Identity of a hash partition; ``path`` is an array of child numbers."""
    return F.concat(F.lit(f"{HASH_LAYOUT:02x}"), _digits(root, 4), _digits(F.size(path), 2), F.array_join(F.transform(path, lambda x: _digits(x, 2)), ""))


def range_id(hk: Column, start: Column, end: Column) -> Column:
    """Identity of a range partition; null bounds are open."""
    flags = F.when(start.isNotNull(), HAS_START).otherwise(0) + F.when(end.isNotNull(), HAS_END).otherwise(0)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    shown = lambda c: F.lower(F.coalesce(F.hex(c), F.lit("")))
    return F.concat(F.lit(f"{RANGE_LAYOUT:02x}"), _digits(flags, 2), _little(size(hk)), _little(size(start)), shown(hk), shown(start), shown(end))


def is_range(identity: Column) -> Column:
    return identity.startswith(f"{RANGE_LAYOUT:02x}")


def _number(identity: Column, byte: int | Column, n: int = 1) -> Column:
    at = F.lit(2 * byte + 1) if isinstance(byte, int) else 2 * byte + 1
    return F.conv(F.substr(identity, at.cast("int"), F.lit(2 * n)), 16, 10).cast("int")


def root_number(identity: Column) -> Column:
    return _number(identity, 1, 2)


def hash_depth(identity: Column) -> Column:
    return _number(identity, 3)


def last_child(identity: Column) -> Column:
    """Its number among its siblings; null for roots."""
    return F.when(hash_depth(identity) > 0, _number(identity, 3 + hash_depth(identity)))


def child_ids(identity: Column, fan_out: int) -> Column:
    """Identities of a hash partition's children, in order."""
    body = F.concat(F.substring(identity, 1, 6), _digits(hash_depth(identity) + 1, 2), F.substring(identity, 9, 1 << 20))
    return F.transform(F.sequence(F.lit(0), F.lit(fan_out - 1)), lambda n: F.concat(body, _digits(n, 2)))


def range_parts(identity: Column) -> Column:
    """``hk``, ``start`` and ``end`` of a range partition's identity."""
    raw = F.unhex(identity)
    little = lambda at: sum((_number(identity, at + i).cast("long") * (1 << 8 * i) for i in range(1, 4)), _number(identity, at).cast("long"))
    hk, start = little(2).cast("int"), little(6).cast("int")
    flag = lambda bit: _number(identity, 1).bitwiseAND(F.lit(bit)) > 0
    return F.struct(
        F.substr(raw, F.lit(11), hk).alias("hk"),
        F.when(flag(HAS_START), F.substr(raw, 11 + hk, start)).alias("start"),
        F.when(flag(HAS_END), F.substr(raw, 11 + hk + start, F.octet_length(raw))).alias("end"),
    )


def name_part_column(key: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.hex(F.substr(key, i, F.lit(1))))
    plain = lambda h: h.between("21", "7D") & ~h.isin(*[f"{b:02X}" for b in ESCAPED])
    made = F.array_join(F.transform(pairs, lambda h: F.when(plain(h), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("%"), h))), "")
    return F.when(F.octet_length(key) > 0, made).otherwise("")


def range_name(table: str, hk: Column, start: Column, end: Column) -> Column:
    bound = lambda c, is_open: F.when(c.isNull(), is_open).otherwise(name_part_column(c))
    return F.concat_ws(".", F.lit(f"{table}.r"), name_part_column(hk), bound(start, OPEN_START), bound(end, OPEN_END))


def hash_name(table: str, identity: Column) -> Column:
    depth = hash_depth(identity)
    way = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: _number(identity, 3 + i).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws(".", F.lit(f"{table}.h"), root_number(identity).cast("string"), way)


def roots(spark: SparkSession, n: int, table: str) -> DataFrame:
    """Identity and name of every root."""
    identity = hash_id(F.col("root"), F.array().cast("array<int>"))
    return spark.range(n).select(F.col("id").cast("int").alias("root")).select("root", identity.alias("partition_id"), F.concat(F.lit(f"{table}.h."), "root").alias("name"))
