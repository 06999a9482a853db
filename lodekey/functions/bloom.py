"""A layered Bloom filter that grows, and the sizes its layers have.

Layer i takes ``n * 2**i`` keys at error ``e * 0.5**(i + 1)``, so the whole
errs less than ``e``.  Exact membership in a query is a semi join; this
filter is for hints that must fit a fixed number of bytes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADDED, PRESENT, FULL = "added", "already_present", "full"


def layer_shape(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a layer."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def _digests(keys: Iterable[bytes]) -> np.ndarray:
    """The two halves of each key's hash, the lower first."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2)
    return raw[:, ::-1].astype(np.uint64)


class LayeredBloom:
    def __init__(self, initial: int = 1024, error: float = 0.01, most_bytes: int = 1 << 20):
        self.initial, self.error, self.most_bytes = initial, error, most_bytes
        self.layers: list[np.ndarray] = []
        self.counts: list[int] = []
        if not self._grow():
            raise ValueError("the first layer doesn't fit")

    def _shape(self, i: int) -> tuple[int, int, int]:
        capacity = self.initial * 2**i
        return capacity, *layer_shape(capacity, self.error * 0.5 ** (i + 1))

    def _grow(self) -> bool:
        _, bits, _ = self._shape(len(self.layers))
        if sum(map(len, self.layers)) + -(-bits // 8) > self.most_bytes:
            return False
        self.layers.append(np.zeros(-(-bits // 8), np.uint8))
        self.counts.append(0)
        return True

    def _bits(self, key: bytes, i: int) -> np.ndarray:
        _, bits, hashes = self._shape(i)
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h & ((1 << 64) - 1), h >> 64 | 1
        return np.array([(a + j * b) % bits for j in range(hashes)])

    def _in(self, key: bytes, i: int) -> bool:
        at = self._bits(key, i)
        return bool((self.layers[i][at >> 3] >> (at & 7) & 1).all())

    def __contains__(self, key: bytes) -> bool:
        return any(self._in(key, i) for i in range(len(self.layers)))

    def add(self, key: bytes) -> str:
        if key in self:
            return PRESENT
        if self.counts[-1] >= self._shape(len(self.layers) - 1)[0] and not self._grow():
            return FULL
        at = self._bits(key, len(self.layers) - 1)
        np.bitwise_or.at(self.layers[-1], at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.counts[-1] += 1
        return ADDED

    def _many_bits(self, digests: np.ndarray, i: int) -> np.ndarray:
        """``_bits`` of many keys, a row each; halves are reduced first, as their sums exceed 64 bits."""
        _, bits, hashes = self._shape(i)
        a, b = digests[:, :1] % np.uint64(bits), (digests[:, 1:] | np.uint64(1)) % np.uint64(bits)
        return ((a + np.arange(hashes, dtype=np.uint64) * b) % np.uint64(bits)).astype(np.int64)

    def _hold(self, digests: np.ndarray) -> np.ndarray:
        held = np.zeros(len(digests), bool)
        for i, layer in enumerate(self.layers):
            at = self._many_bits(digests, i)
            held |= (layer[at >> 3] >> (at & 7) & 1).all(axis=1)
        return held

    def hold(self, keys: Iterable[bytes]) -> np.ndarray:
        """Whether it has each of many keys."""
        return self._hold(_digests(keys))

    def add_all(self, keys: Iterable[bytes]) -> tuple[int, int]:
        """Adds many keys: how many were new, and how many found the filter full."""
        added, left = 0, np.unique(_digests(keys), axis=0)
        while len(left := left[~self._hold(left)]):
            if self.counts[-1] >= self._shape(len(self.layers) - 1)[0] and not self._grow():
                break
            some, left = np.split(left, [self._shape(len(self.layers) - 1)[0] - self.counts[-1]])
            at = self._many_bits(some, len(self.layers) - 1)
            np.bitwise_or.at(self.layers[-1], at >> 3, (1 << (at & 7)).astype(np.uint8))
            self.counts[-1] += len(some)
            added += len(some)
        return added, len(left)

    @property
    def most_keys(self) -> int:
        """How many keys all layers that fit can take."""
        n, i, left = 0, 0, self.most_bytes
        while (left := left - -(-self._shape(i)[1] // 8)) >= 0:
            n, i = n + self._shape(i)[0], i + 1
        return n

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, head=np.array([self.initial, self.most_bytes]), error=np.array([self.error]), counts=np.array(self.counts), **{f"l{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> LayeredBloom:
        got = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.initial, self.most_bytes = map(int, got["head"])
        self.error, self.counts = float(got["error"][0]), got["counts"].tolist()
        self.layers = [got[f"l{i}"] for i in range(len(self.counts))]
        return self


def sizing(spark: SparkSession, initial: int, error: float, layers: int) -> DataFrame:
    """Capacity, bits, hashes and bytes so far of each layer, by arithmetic."""
    i = F.col("layer")
    capacity = (F.lit(initial) * F.pow(F.lit(2.0), i)).cast("long")
    bits = F.ceil(-capacity * F.log(F.lit(error) * F.pow(F.lit(0.5), i + 1)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))
    rows = spark.range(layers).select(F.col("id").cast("int").alias("layer")).select("layer", capacity.alias("capacity"), bits.alias("bits"))
    rows = rows.withColumns({"hashes": F.round(F.col("bits") / F.col("capacity") * F.log(F.lit(2.0))).cast("long"), "bytes": F.ceil(F.col("bits") / 8)})
    return rows.withColumn("bytes_so_far", F.sum("bytes").over(Window.orderBy("layer")))  # as many rows as layers


def may_contain(df: DataFrame, key: str, bloom: LayeredBloom, name: str = "maybe") -> DataFrame:
    """Adds whether the filter may hold the key."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)  # at most bloom.most_bytes

    @F.pandas_udf("boolean")
    def test(keys):
        return keys.map(lambda k: k is not None and bytes(k) in shared.value)

    return df.withColumn(name, test(F.col(key)))
