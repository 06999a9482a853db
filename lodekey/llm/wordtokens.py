"""Token ids of the lower-casing word BPE, equal to the tokenizers library's.

A text of plain characters (lower-cased by the same rule in Python and in
the library, and composed already) is split by the vocabulary's own pattern
into words.  Words recur; each distinct one is merged once per cache, many
at a time in numpy.  Other texts, and very long words, go to the library.
"""

from __future__ import annotations

import json
import re
import threading

import numpy as np

from lodekey.llm.wordcache import PieceCache

_LOWER = "a-zàâäçéèêëîïôöùûüÿñáíóúß"
_ODD = re.compile(rf"[^\n -~{_LOWER}ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸÑÁÍÓÚ]")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")
_LONGEST = 64
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class PairRanks:
    """Ranks of symbol pairs by a hash table with linear probing, in numpy."""

    BITS = 20

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        size = 1 << self.BITS
        self.keys = np.full(size + 64, -1, np.int64)
        self.rank = np.full(size + 64, _NONE, np.int32)
        self.merged = np.append(merged, 0)
        self.probes = 1
        for rank, key in enumerate(pairs.tolist()):
            at = first = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.rank[at] = key, rank
            self.probes = max(self.probes, at - first + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.rank[at], _NONE)
        left = np.flatnonzero((got != keys) & (got != -1))
        for step in range(1, self.probes):
            if not len(left):
                break
            got = self.keys[at[left] + step]
            hit = got == keys[left]
            out[left[hit]] = self.rank[at[left[hit]] + step]
            left = left[~hit & (got != -1)]
        return out


class WordTokens:
    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        split = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in split], np.int64)
        self.ranks = PairRanks(pairs, np.array([vocab[a + b] for a, b in split], np.int32))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        self.words = PieceCache(self._encode_words, most)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(words), 50_000):
            raw = [w.encode() for w in words[i : i + 50_000]]
            long = {j for j, r in enumerate(raw) if len(r) > _LONGEST}
            made = self.merge([b"a" if j in long else r for j, r in enumerate(raw)])
            for j in long:
                made[j] = self._whole([words[i + j]])[0]
            out += made
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Applies, in each word at once, the pair of least rank, until none is left."""
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        rank = self._pair_ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(least != _NONE, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                least, sizes = least[least != _NONE], sizes[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            again = hit[1:] & hit[:-1]
            if again.any():  # the same pair overlaps itself: take every other one of a run
                at = np.flatnonzero(hit)
                run = np.cumsum(np.r_[True, np.diff(at) > 1])
                first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                hit[at[nth % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.ranks.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            before = at - 1
            gone = (before >= 0) & ~keep[np.maximum(before, 0)]
            touched[np.maximum(at[gone] - 2, 0)] = True
            sym, word, rank, touched = sym[keep], word[keep], rank[keep], touched[keep]
            new = np.flatnonzero(touched)
            rank[new] = self._pair_ranks(sym, word, new)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        cuts = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        cuts = cuts.tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _pair_ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(sym) - 1)
        got = self.ranks.find(sym[at] * self.width + sym[after])
        got[(word[at] != word[after]) | (after == at)] = _NONE
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        odd = [i for i, t in enumerate(texts) if _ODD.search(t) or "<|" in t]
        out: list = [_WORD.findall(t.lower()) for t in texts] if not odd else [None if i in set(odd) else _WORD.findall(t.lower()) for i, t in enumerate(texts)]
        self.words.learn(set().union(*(s for s in out if s is not None)))
        get = self.words.__getitem__
        made = [b"" if s is None else b"".join(map(get, s)) for s in out]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            made[i] = ids
        return made


_lock, _made = threading.Lock(), {}


def shared(path: str) -> WordTokens:
    """One per worker process, kept for later tasks."""
    with _lock:
        if path not in _made:
            _made[path] = WordTokens(path)
        return _made[path]
