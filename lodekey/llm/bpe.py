"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a piece ends in exactly one token, and the
encoding of the piece is found by walking those last tokens backwards.  The
last token of a prefix is the one whose start is the end of another prefix
and which may follow that prefix's last token: a pair of tokens may stand
together if merging their joined bytes gives the same pair back.  The table
of last tokens needs nothing to the right, so bytes can be appended exactly,
and after an edit it is computed again only until it agrees with what it
was for as many bytes as the longest token has.

Pieces recur, so texts are encoded through a bounded cache of pieces.

Defined results: null text is empty and has no ids; special tokens' strings
are ordinary text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import staging
from lodekey.llm.wordcache import PieceCache

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_LETTERS = "A-Za-zàâäçéèêëîïôöùûüÿñáíóúßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸÑÁÍÓÚ"
_ODD = re.compile(rf"[^\n -~{_LETTERS}]")
# Fixed value: the pattern that _PIECE stands for on texts of those characters only.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")  # the vocabulary's pattern on those characters


class BytePairs:
    """A byte-level BPE vocabulary given by the ranks of its tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = [0] * 256  # by last byte
        for token in ranks:
            self.longest[token[-1]] = max(self.longest[token[-1]], len(token))
        self.reach = max(self.longest)
        self._alone: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Merges pairs by least rank; for short strings only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_start(self, token: int) -> bool:
        if (got := self._alone.get(token)) is None:
            got = self._alone[token] = self.merge(self.tokens[token]) == [token]
        return got

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (got := self._pairs.get(key)) is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            got = self._pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return got

    def extend(self, raw: bytes, last: list[int], stop: int | None = None) -> None:
        """Adds the last token of each prefix of ``raw`` beyond those known."""
        get, longest, pairs = self.ranks.get, self.longest, self._pairs
        for end in range(len(last) + 1, (len(raw) if stop is None else stop) + 1):
            for start in range(max(0, end - longest[raw[end - 1]]), end):
                token = get(raw[start:end])
                if token is None:
                    continue
                if start == 0:
                    fits = self.may_start(token)
                else:
                    fits = pairs.get(last[start - 1] << 32 | token)
                    if fits is None:
                        fits = self.may_follow(last[start - 1], token)
                if fits:
                    last.append(token)
                    break

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return ids[::-1]

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(raw, last)
        return self.walk(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """One piece with the last token of each of its prefixes, for edits."""

    def __init__(self, pairs: BytePairs, raw: bytes = b""):
        self.pairs, self.raw, self.last = pairs, b"", []
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.pairs.extend(self.raw, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of raw[start:stop]; how many entries it computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.raw = self.raw[:start] + new + self.raw[stop:]
        self.last = old[:start]
        agree, done = 0, 0
        while len(self.last) < len(self.raw):
            self.pairs.extend(self.raw, self.last, len(self.last) + 1)
            done += 1
            was = len(self.last) - 1 - shift
            # an entry looks back no further than the longest token
            agree = agree + 1 if len(self.last) > start + len(new) and old[was] == self.last[-1] else 0
            if agree >= self.pairs.reach:
                self.last += old[was + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        whole = self.pairs.ranks.get(self.raw)
        return [whole] if whole is not None else self.pairs.walk(self.last)


class Encoder:
    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import regex

        with open(path, "rb") as f:
            self.pairs = BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern = regex.compile(pattern)
        self.quick = _PIECE if pattern == KNOWN_PATTERN else self.pattern
        self.pieces = PieceCache(self._encode, most)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        one = self.pairs.encode_piece
        return [np.array(one(p.encode()), "<u4").tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [(self.pattern if _ODD.search(t) else self.quick).findall(t) for t in texts]
        self.pieces.learn(set().union(*split))
        get = self.pieces.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return self.pairs.decode(np.frombuffer(ids, "<u4").tolist())


_lock, _made = threading.Lock(), {}


def shared(path: str, pattern: str) -> Encoder:
    """One per worker process, kept for later tasks."""
    with _lock:
        if (path, pattern) not in _made:
            _made[path, pattern] = Encoder(path, pattern)
        return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes them again; digests, and ids if asked."""
    staging.ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(path, pattern)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), 1000):
                raw = encoder.encode(texts[i : i + 1000])
                cols = [
                    keys.slice(i, 1000),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                    pa.array([hashlib.sha256(encoder.decode(r)).hexdigest() for r in raw]),
                ]
                if ids:
                    cols.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED + ", ids array<int>" * ids)
