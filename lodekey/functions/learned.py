"""What a router has learned: keys that have a range tree of their own."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodekey.functions.bloom import ADDED, FULL, LayeredBloom, may_contain
from lodekey.sources.written import written


class LearnedKeys:
    """A hint of fixed size: a key that it lacks has certainly not been learned."""

    def __init__(self, most_bytes: int = 1 << 20, initial: int = 1024, error: float = 0.01):
        self.bloom, self.refused = LayeredBloom(initial, error, most_bytes), 0

    def learn(self, keys: Iterable[bytes]) -> bool:
        """Whether any was new; ``refused`` counts those that found the filter full."""
        new = False
        for k in keys:
            got = self.bloom.add(k)
            new |= got == ADDED
            self.refused += got == FULL
        return new

    def learn_table(self, promoted: DataFrame, most: int) -> bool:
        """Learns up to ``most`` keys of a table, the first by a hash of theirs."""
        some = promoted.select("hk").distinct().orderBy(F.xxhash64("hk"), "hk").limit(most)
        return self.learn(bytes(r["hk"]) for r in some.toLocalIterator())

    def __contains__(self, key: bytes) -> bool:
        return key in self.bloom

    def __len__(self) -> int:
        return sum(self.bloom.counts)

    def column(self, df: DataFrame, key: str, name: str = "maybe") -> DataFrame:
        return may_contain(df, key, self.bloom, name)

    def to_bytes(self) -> bytes:
        return self.bloom.to_bytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> LearnedKeys:
        self = cls.__new__(cls)
        self.bloom, self.refused = LayeredBloom.from_bytes(raw), 0
        return self


def _runs(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's slices of one value each, of rows that are sorted by it."""
    v = batch.column(name).to_numpy()
    for a, b in pairwise([0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]):
        if a < b:
            yield int(v[a]), batch.slice(a, b - a)


class DealtKeys:
    """Hints of a fixed size each, as many as hold all keys of a table.

    A hash of the key tells its share, and each share has a hint, a row of a
    table: made and asked in one task, and never on the driver.
    """

    def __init__(self, hints: DataFrame, shares: int):
        self.hints, self.shares = hints, shares

    @staticmethod
    def _share(key: str, shares: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("_share")

    @classmethod
    def learn(cls, promoted: DataFrame, most_bytes: int = 1 << 20, initial: int = 1024, error: float = 0.01) -> DealtKeys:
        """Learns all keys of a table of different ones; shares are ten standard deviations smaller than a hint holds."""
        room = (math.sqrt(LayeredBloom(initial, error, most_bytes).most_keys + 25) - 5) ** 2
        shares = max(1, math.ceil(promoted.count() / room))

        def run(share: pa.Table) -> pa.Table:
            bloom = LayeredBloom(initial, error, most_bytes)
            added, refused = bloom.add_all(share.column("hk").to_pylist())
            if refused:
                raise ValueError(f"{refused} keys of a share don't fit into its hint")
            return pa.table({"_share": share.column("_share")[:1], "learned": [added], "_hint": [bloom.to_bytes()]})

        dealt = promoted.select("hk", cls._share("hk", shares)).repartition(shares, "_share")
        return cls(dealt.groupBy("_share").applyInArrow(run, "_share int, learned long, _hint binary"), shares)

    def stored(self) -> DealtKeys:
        return DealtKeys(written(self.hints, "learned-keys"), self.shares)

    def count(self) -> int:
        """How many keys were new to their hints."""
        return self.hints.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]

    def column(self, df: DataFrame, key: str, name: str = "maybe") -> DataFrame:
        """Adds whether a hint may hold the key; rows of a share are streamed through one task."""
        asked = df.select("*", self._share(key, self.shares), F.lit(None).cast("binary").alias("_hint"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        both = asked.unionByName(self.hints.select(*none, "_share", "_hint"))
        first = both.repartition(self.shares, "_share").sortWithinPartitions("_share", F.col("_hint").isNull())

        def run(batches):
            of = bloom = None
            for batch in batches:
                for share, rows in _runs(batch, "_share"):
                    if share != of:
                        of, bloom = share, None
                    if rows.column("_hint")[0].is_valid:  # its hint comes before all else
                        bloom, rows = LayeredBloom.from_bytes(rows.column("_hint")[0].as_py()), rows.slice(1)
                    values = rows.column(key).to_pylist()
                    held = bloom.hold([k or b"" for k in values]) if bloom else np.zeros(len(values), bool)
                    maybe = held & np.array([k is not None for k in values], bool)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(maybe)], [*rows.schema.names[:-2], name])

        return first.mapInArrow(run, StructType([*df.schema, StructField(name, BooleanType())]))
