"""Page budgets and cursors: where a page ends and the next begins."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from lodekey.plans.intervals import Interval
from lodekey.schema import DEFAULT_PAGE_BYTES, MAX_PAGE_BYTES, MAX_PAGE_VISITS

VERSION = 1


class CursorError(ValueError):
    """A cursor that doesn't belong to the request."""


@dataclass
class PageBudget:
    """Items, bytes and leaf visits that a page may still take."""

    items: int | None = None
    bytes: int = DEFAULT_PAGE_BYTES
    visits: int = MAX_PAGE_VISITS

    @classmethod
    def of(cls, items: int | None, max_bytes: int | None, visits: int = MAX_PAGE_VISITS) -> PageBudget:
        """As asked for, within the limits of the public interface."""
        return cls(items, min(DEFAULT_PAGE_BYTES if max_bytes is None else max_bytes, MAX_PAGE_BYTES), visits)

    def spend(self, items: int = 0, bytes: int = 0, visits: int = 0) -> None:
        if self.items is not None:
            self.items -= items
        self.bytes -= bytes
        self.visits -= visits

    @property
    def exhausted(self) -> bool:
        return self.bytes <= 0 or self.visits <= 0 or (self.items is not None and self.items <= 0)


def fingerprint(parts: list[tuple[bytes, Interval | None, bool]]) -> str:
    """Digest of the ordered sub-queries; budgets and cursor aren't part of it."""
    shown = [[hk.hex(), None if i is None else [i.low and i.low.hex(), i.low_in, i.high and i.high.hex(), i.high_in], forward] for hk, i, forward in parts]
    return hashlib.sha256(json.dumps(shown).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Cursor:
    """The sub-query to go on with, behind ``after`` (or with it) or from its begin."""

    index: int
    forward: bool
    fingerprint: str
    after: bytes | None = None
    included: bool = False

    def encode(self) -> str:
        body = {"v": VERSION, "i": self.index, "f": self.forward, "p": self.fingerprint, "a": None if self.after is None else self.after.hex(), "n": self.included}
        return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            got = cls(int(body["i"]), bool(body["f"]), str(body["p"]), None if body["a"] is None else bytes.fromhex(body["a"]), bool(body["n"]))
            version = body["v"]
        except (ValueError, KeyError, TypeError):
            raise CursorError("malformed cursor") from None
        if version != VERSION:
            raise CursorError("cursor of another version")
        return got

    def check(self, parts: list[tuple[bytes, Interval | None, bool]]) -> None:
        if not 0 <= self.index < len(parts):
            raise CursorError("cursor index out of range")
        if self.forward != parts[self.index][2]:
            raise CursorError("cursor direction mismatch")
        if self.fingerprint != fingerprint(parts):
            raise CursorError("cursor fingerprint mismatch")
