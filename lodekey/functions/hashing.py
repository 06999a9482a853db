"""Placement hashes.

Placement shows in no query's result, so partitions are chosen by a hash
that any SQL engine can repeat: the first eight digits of MD5, salted by the
depth.  XXH32 and XXH64 with the seeds of the model are there for callers who
must agree with other stores on values.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SEED = 0x9E3779B1
DEPTH_STEP = 0x85EBCA77


def seed_for_depth(depth: int) -> int:
    return (SEED ^ (depth * DEPTH_STEP)) & 0xFFFFFFFF


def hash64(raw: bytes, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(raw, seed)


def hash32(raw: bytes, seed: int = SEED) -> int:
    return xxhash.xxh32_intdigest(raw, seed)


def xxh32_root(hk: bytes, roots: int) -> int:
    return hash32(hk, seed_for_depth(0)) % roots


def xxh32_child(hk: bytes, depth: int, fan_out: int) -> int:
    return hash32(hk, seed_for_depth(depth + 1)) % fan_out


@F.pandas_udf(LongType())
def xxh32_column(hk: pd.Series, depth: pd.Series) -> pd.Series:
    """XXH32 with the depth's seed, batch by batch."""
    return pd.Series([hash32(k, seed_for_depth(int(d))) for k, d in zip(hk, depth, strict=True)], dtype="int64")


def bucket(hk: Column, depth: int, n: int) -> Column:
    """One of ``n`` buckets: MD5 of the depth, a colon and the key."""
    digest = F.md5(F.concat(F.encode(F.lit(f"{depth}:"), "UTF-8"), hk))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")
