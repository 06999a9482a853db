"""A bounded cache from text pieces to encoded ids, filled in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class PieceCache(dict):
    """Maps a piece to its ids as little-endian 32-bit bytes.

    Texts are made of pieces that recur, so most look-ups hit.  When more
    than ``most`` entries or ``most_bytes`` are held all are forgotten: that
    costs time, never results.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = 400_000, most_bytes: int = 32 << 20):
        super().__init__()
        self.encode, self.most, self.most_bytes, self.bytes = encode, most, most_bytes, 0

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) and (len(self) + len(new) > self.most or self.bytes + sum(map(len, new)) > self.most_bytes):
            self.clear()
            self.bytes, new = 0, list(pieces)
        made = list(self.encode(new))
        self.bytes += sum(map(len, new)) + sum(map(len, made))
        self.update(zip(new, made, strict=True))
