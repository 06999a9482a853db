"""XXH64 values of word shingles of a text with A-Z in lower case."""

from __future__ import annotations

import re
from functools import partial
from itertools import accumulate

import numpy as np
import xxhash

SEED = 42
CHUNK = 1 << 20  # bytes whose words are held at a time

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")  # as bytes.split does
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-width])]
    return np.fromiter((_hash(joined[a:b]) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """In order, repeats included; of fewer words than ``width`` that of them all."""
    raw, at = text.encode().translate(_LOWER), 0
    out: list[np.ndarray] = []
    words: list[bytes] = []
    while at < len(raw):
        end = at + CHUNK
        blank = _BLANK.search(raw, end) if end < len(raw) else None
        end = blank.start() if blank else len(raw)
        words += raw[at:end].split()
        if len(words) >= width:
            out.append(_hashes(words, width))
            words = words[len(words) - width + 1 :]
        at = end
    if not out and words:
        out.append(np.array([_hash(b" ".join(words))], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
