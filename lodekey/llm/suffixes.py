"""Repeated byte strings by a hash-compared suffix sort over anchors.

Every string of ``LENGTH`` bytes holds an anchor: of its parts of ``PART``
bytes, the one of least hash.  Equal strings hold equal anchors at one
place, so only anchors that occur again can be in a repeated string.

1. Each text is read once.  Its anchors are found with prefix polynomial
   hashes, with the run of strings that each is the anchor of and a BLAKE2
   digest of that run.  Texts are kept compressed in archives and are read
   again by their place, so they are never shuffled.  Equal texts are one
   class; all of a class of two or more rows is repeated, and one of its
   texts stands for it below.  Runs that one text holds twice are repeated,
   and one of them stands for them.
2. Anchors that occur in two or more places are kept (a count and a join).
   Equal runs are one class: all of a class of two or more is repeated, and
   one of them stands for it.  Anchors with one class need no more.
3. Surroundings of the others are sent to the task of their anchor.  Strings
   that begin in one block of ``BLOCK`` places share a core.  A mergesort
   that compares suffixes by the length of their common extension, found by
   binary search over prefix hashes, brings equal cores together; then equal
   surroundings, and only at the edges of repeats single strings, are
   compared.  What the hashes call equal is compared byte by byte.
4. The suffixes of an anchor of over ``HOT`` classes are sorted by many tasks:
   Spark ranges them by sampled pivots and sorts each range by its bytes.
   What surrounds cores found equal is then grouped by its bytes, which Spark
   combines before it is sent, so that no task holds a frequent core whole.
   This changes where the work is done, not what is found.

Spans leave each task merged; those of a text meet once.

Passages of words are found in the same way: each word becomes a code of
``WORD`` bytes, so a passage of n words is a string of n * ``WORD`` bytes,
however short its words are and whatever blanks part them.

Defined results: null text is empty; texts of under ``LENGTH`` bytes hold no
such string; repeated rows repeat each other; very long texts are searched in
stretches and give what they would give whole; columns that are kept may have
any names, but one named like a column of the result gives way to it; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.llm import files, staging
from lodekey.llm.archives import ROW_BITS, archive, by_archive, texts_at
from lodekey.llm.rolling import mix, part_hashes, powers, prefix_sums

LENGTH = 400
PART = 128
BLOCK = 32
HOT = 1000
BATCH_BYTES = 1 << 19
STRETCH = 1 << 18  # places searched at a time
PORTION = 1 << 20  # bytes of short texts searched together
WORD = 8  # bytes of a word's code
_POSITION = 19  # bits of a place in a stretch and what its last strings reach
# A spot packs where an anchor and its first and last strings begin, and whether
# its text holds the run again.
_REACH_BITS = 10
_REMEMBERED = 50_000  # texts of a task whose copies are not stored again

_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LONE = np.isin(np.arange(256), range(0xE3, 0xEA))  # begins a character from U+3000 to U+9FFF

_LONGS = ["anchors", "d1", "d2", "spots", "own_first", "own_last"]
READ = "rid long, at long, packed long, n_bytes long, sha binary, first boolean, " + ", ".join(f"{x} array<long>" for x in _LONGS)


# ------------------------------------------------------------------------ words


def word_codes(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Codes of the words, and where each begins and ends.

    Blanks part words; where scripts have none (U+3000 to U+9FFF), each
    character begins a word.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank, lone = _BLANK[data], _LONE[data]
    start = np.flatnonzero(~blank & (lone | np.r_[True, blank[:-1]]))
    end = np.flatnonzero(~blank & np.r_[(blank | lone)[1:], True]) + 1
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + STRETCH)))
        sums = prefix_sums(data[start[i] : end[j - 1]])
        out.append(mix(part_hashes(sums, start[i:j] - start[i], end[i:j] - start[i:j])).astype("<u8").tobytes())
        i = j
    return b"".join(out), start, end


def _length(words: int) -> int:
    """Bytes of a string, or of the codes of so many words."""
    length = words * WORD or LENGTH
    if not PART + BLOCK <= length < PART + (1 << _REACH_BITS):
        raise ValueError(f"passages can't have {words} words")
    return length


# ---------------------------------------------------------------------- anchors


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima in blocks."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[: n - width + 1], down[width - 1 : n])


def _stretch_runs(data: np.ndarray, base: np.ndarray, size: np.ndarray, s: int, m: int, length: int) -> np.ndarray:
    """Text, place, hash, and first and last string begin of anchors; begins from ``s``, ``m`` of them."""
    k = m + length - PART
    sums = prefix_sums(data[s : s + m + length - 1])
    h = mix((sums[PART : PART + k] - sums[:k]) * powers(k)[1][:k])
    low = np.uint64((1 << _POSITION) - 1)
    anchor = (_sliding_least((h & ~low) | np.arange(k, dtype=np.uint64), k - m + 1) & low).astype(np.int64)
    begin = np.arange(s, s + m)
    text = np.searchsorted(base, begin, "right") - 1
    inside = np.flatnonzero(begin + length <= (base + size)[text])
    begin, text, anchor = begin[inside], text[inside], anchor[inside]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(begin)])
    last = np.r_[new[1:], len(begin)][: len(new)] - 1
    return np.stack([text[new], anchor[new] + s, h[anchor[new]].view(np.int64), begin[new], begin[last]])


def _once_per_text(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the runs that a text holds twice or more, and the begins of all of those.

    Rows of ``runs``: text, place, hash, first, last, two of the digest, again.
    """
    order = np.lexsort(runs[[3, 6, 5, 2, 0]])
    r = runs[:, order]
    new = np.r_[True, (r[[0, 2, 5, 6], 1:] != r[[0, 2, 5, 6], :-1]).any(0)][: r.shape[1]]
    number = np.cumsum(new) - 1
    many = np.bincount(number, minlength=1)[number] > 1 if r.shape[1] else np.zeros(0, bool)
    one = r[:, new].copy()
    one[7] |= many[new]
    return one[:, np.lexsort(one[[3, 0]])], r[:, many][[0, 3, 4]]


def merged(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (first and last places) of each group, in order; neighbours are one."""
    if not len(group):
        return group, first, last
    order = np.lexsort((first, group))
    group, first, last = group[order], first[order], last[order]
    wide = int(last.max()) + 2
    reach = np.maximum.accumulate(last + group * wide)
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (first[1:] + group[1:] * wide > reach[:-1] + 1)])
    return group[new], first[new], reach[np.r_[new[1:], len(group)] - 1] - group[new] * wide


def find_anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of many texts, and spans of strings that one text holds twice.

    Rows of the first: text, place, hash, first and last string begin, digest
    of the run in two numbers, whether the text holds the run again.  Rows of
    the second: text, first and last string begin.
    """
    size = np.array([len(t) for t in texts], np.int64)
    kept, spans = [np.zeros((8, 0), np.int64)], [np.zeros((3, 0), np.int64)]
    if len(size) and size.max() >= length:
        base = np.cumsum(size) - size
        raw = b"".join(texts)
        data, view = np.frombuffer(raw, np.uint8), memoryview(raw)
        n, held = len(data) - length + 1, np.zeros((5, 0), np.int64)
        for s in range(0, n, STRETCH):
            runs = _stretch_runs(data, base, size, s, min(STRETCH, n - s), length)
            if held.size and runs.size and (runs[:2, 0] == held[:2, 0]).all():
                runs[3, 0] = held[3, 0]  # a run that goes on from the stretch before
            else:
                runs = np.concatenate([held, runs], axis=1)
            runs, held = (runs[:, :-1], runs[:, -1:]) if s + STRETCH < n else (runs, held)
            digest = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(runs[3].tolist(), (runs[4] + length).tolist(), strict=True))
            d = np.frombuffer(digest, np.int64).reshape(-1, 2).T
            one, twice = _once_per_text(np.concatenate([runs, d, np.zeros((1, runs.shape[1]), np.int64)]))
            kept.append(one)
            spans.append(np.stack(merged(*twice)))
        one, twice = _once_per_text(np.concatenate(kept, axis=1)) if len(kept) > 2 else (kept[-1], spans[0])
        kept, spans = [one], [*spans, twice]
        one[[1, 3, 4]] -= base[one[0]]
    found, own = kept[0], np.concatenate(spans, axis=1)
    if own.size:
        own = np.stack(merged(*own))
        own[1:] -= base[own[0]]
    return found, own


def _lists(text: np.ndarray, n: int, values: list[np.ndarray]) -> list[pa.Array]:
    """Columns of lists, from values in order of their text."""
    bounds = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=n))].astype(np.int32))
    return [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(v))) for v in values]


def read_texts(docs: DataFrame, folder: str, keep: list[str], words: int = 0) -> DataFrame:
    """One row per row of ``docs``: ``kept``, its text's place, digest and anchors."""
    from pyspark.sql.types import StructType

    chosen = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    schema, length = StructType([chosen.schema["kept"], *StructType.fromDDL(READ)]), _length(words)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, row, at = TaskContext.get().taskAttemptId(), 0, 0  # each attempt has an archive of its own
        seen: dict[bytes, tuple[int, int]] = {}
        pack = zstandard.ZstdCompressor(level=1)
        with files.replacing(archive(folder, task)) as out:
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
                for start, stop in _portions(sizes):
                    n = stop - start
                    part = [(t or "").encode() for t in b.column(1).slice(start, n).to_pylist()]
                    sha = [hashlib.sha256(t).digest() for t in part]
                    place, fresh = [], []
                    if len(seen) > _REMEMBERED:
                        seen.clear()
                    for i, (d, t) in enumerate(zip(sha, part, strict=True)):
                        if d not in seen:
                            z = pack.compress(t)
                            out.write(z)
                            seen[d] = (at, len(z))
                            at += len(z)
                            fresh.append(i)
                        place.append(seen[d])
                    found, own = find_anchors([word_codes(part[i])[0] if words else part[i] for i in fresh], length)
                    t, pos, kh, first, last, d1, d2, again = found
                    spot = pos << (2 * _REACH_BITS + 1) | (pos - first) << (_REACH_BITS + 1) | (pos - last) << 1 | again
                    old = np.array(fresh, np.int64)
                    is_first = np.zeros(n, bool)
                    is_first[fresh] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(start, n),
                            pa.array(np.arange(row, row + n) + (task << ROW_BITS)),
                            pa.array([p[0] for p in place], pa.int64()),
                            pa.array([p[1] for p in place], pa.int64()),
                            pa.array(sizes[start:stop], pa.int64()),
                            pa.array(sha, pa.binary()),
                            pa.array(is_first),
                            *_lists(old[t], n, [kh, d1, d2, spot]),
                            *_lists(old[own[0]], n, [own[1], own[2]]),
                        ],
                        names=names,
                    )
                    row += n
        # an empty partition leaves an empty archive and no rows

    return chosen.mapInArrow(run, schema)


def _portions(sizes: list[int], most: int = PORTION) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


# ------------------------------------------------------------- the suffix sort


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of what the suffixes at ``a`` and ``b`` begin with alike."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    high[part_hashes(sums, a, most) == part_hashes(sums, b, most)] = -1
    same = high < 0
    low[same], high[same] = most, most
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        mid = (low[todo] + high[todo] + 1) >> 1
        equal = part_hashes(sums, a[todo], mid) == part_hashes(sums, b[todo], mid)
        low[todo] = np.where(equal, mid, low[todo])
        high[todo] = np.where(equal, high[todo], mid - 1)


def _before(data: np.ndarray, sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, ties: bool | np.ndarray) -> np.ndarray:
    """Whether suffix ``a`` sorts before ``b``; equal ones as ``ties`` says."""
    n = common_extension(sums, a, b, most)
    last = len(data) - 1
    return np.where(n == most, ties, data[np.minimum(a + n, last)] < data[np.minimum(b + n, last)])


def sort_suffixes(data: np.ndarray, sums: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of suffixes ``at`` by group, then by their first ``most`` bytes.

    ``group`` is sorted.  A bottom-up mergesort of all groups at once: each
    suffix finds its place in the neighbouring run by binary search.
    """
    n = len(at)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    start, total = np.repeat(first, size), np.repeat(size, size)
    order, width = np.arange(n), 1
    while width < size.max(initial=1):
        i = np.flatnonzero(total > width)
        inner = i - start[i]
        left = (inner // width) % 2 == 0
        run = inner - inner % width
        lo = start[i] + np.where(left, run + width, run - width)
        end = start[i] + total[i]
        lo, hi = np.minimum(lo, end), np.minimum(np.where(left, lo + width, lo + width), end)
        from_, own = lo.copy(), at[order[i]]
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) >> 1
            other = at[order[mid]]
            goes = _before(data, sums, other, own[todo], most, ~left[todo])  # of equal ones the left run's come first
            lo[todo] = np.where(goes, mid + 1, lo[todo])
            hi[todo] = np.where(goes, hi[todo], mid)
        place = start[i] + np.where(left, run, run - width) + inner % width + (lo - from_)
        merged = order.copy()
        merged[place] = order[i]
        order = merged
        width *= 2
    return order


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 2000):
        x, y, n = a[i : i + 2000], b[i : i + 2000], length[i : i + 2000]
        steps = np.arange(n.max(initial=0))
        inside = steps < n[:, None]
        last = len(data) - 1
        out[i : i + 2000] = ((data[np.minimum(x[:, None] + steps, last)] == data[np.minimum(y[:, None] + steps, last)]) | ~inside).all(1)
    return out


def _again(data: np.ndarray, keys: list[np.ndarray], at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which entries have another one of equal keys and, indeed, equal bytes."""
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(order)])
    many = size[number] > 1
    other = np.where(np.arange(len(order)) == first[number], np.minimum(first[number] + 1, len(order) - 1), first[number])
    out = np.zeros(len(at), bool)
    sure = np.flatnonzero(many)
    equal = _same_bytes(data, at[order[sure]], at[order[other[sure]]], length[order[sure]])
    out[order[sure[equal]]] = True
    for k in np.unique(number[sure[~equal]]):  # a collision: sort that group out by its bytes
        rows = order[number == k]
        by_bytes: dict[bytes, list[int]] = {}
        for r in rows.tolist():
            by_bytes.setdefault(data[at[r] : at[r] + length[r]].tobytes(), []).append(r)
        for same in by_bytes.values():
            out[same] = len(same) > 1
    return out


def repeated_in_groups(kh: np.ndarray, contexts: list[bytes], anchor: np.ndarray, least: np.ndarray, most: np.ndarray, alone: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, and first and last offset of string begins before the anchor, of repeats.

    Entries of one ``kh`` stand together.  ``anchor`` is the anchor's place in
    the context; its strings begin ``least`` to ``most`` bytes before it.
    Entries that aren't ``alone`` are known to repeat and only matter to others.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sums = prefix_sums(data)
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(size) - size
    blocks = most // BLOCK - least // BLOCK + 1
    entry = np.repeat(np.arange(len(kh)), blocks)
    block = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + (least // BLOCK)[entry]
    group = np.unique(kh, return_inverse=True)[1][entry] * 64 + block
    order = np.argsort(group, kind="stable")
    entry, block, group = entry[order], block[order], group[order]
    core = base[entry] + anchor[entry] - BLOCK * block
    shared_bytes = length - BLOCK + 1
    order = sort_suffixes(data, sums, core, group, shared_bytes)
    entry, block, group, core = entry[order], block[order], group[order], core[order]
    alike = np.zeros(len(core), bool)
    pair = np.flatnonzero(group[1:] == group[:-1])
    alike[pair + 1] = common_extension(sums, core[pair], core[pair + 1], shared_bytes) == shared_bytes
    cls = np.cumsum(~alike) - 1
    shared = (np.bincount(cls) > 1) & (np.bincount(cls, alone[entry]) > 0)
    shared = shared[cls]
    entry, block, core, cls = entry[shared], block[shared], core[shared], cls[shared]
    if not len(entry):
        return (np.zeros(0, np.int64),) * 3
    # whole surroundings, cut off where the text begins or ends
    left = np.maximum(core - (BLOCK - 1), base[entry])
    right = np.minimum(core + length, (base + size)[entry])
    hull = part_hashes(sums, left, right - left)
    full = _again(data, [cls, core - left, right - core, hull], left, right - left)
    lo, hi = np.maximum(BLOCK * block, least[entry]), np.minimum(BLOCK * block + BLOCK - 1, most[entry])
    found = [(entry[full], lo[full], hi[full])]
    mixed = np.zeros(cls.max() + 1, bool)
    mixed[cls[~full & alone[entry]]] = True
    rest = np.flatnonzero(mixed[cls])
    if len(rest):
        many = hi[rest] - lo[rest] + 1
        e = np.repeat(rest, many)
        back = np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many) + lo[e]
        at = base[entry[e]] + anchor[entry[e]] - back
        hit = _again(data, [cls[e], back, part_hashes(sums, at, length)], at, np.full(len(at), length))
        found.append((entry[e[hit]], back[hit], back[hit]))
    entry, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    own = alone[entry]
    return merged(entry[own], lo[own], hi[own])


# ----------------------------------------------------------------------- tables


def _anchor(spot: np.ndarray) -> list[np.ndarray]:
    """Where anchors begin, and how far before them their last and first strings do."""
    mask = (1 << _REACH_BITS) - 1
    return [spot >> 2 * _REACH_BITS + 1, spot >> 1 & mask, spot >> _REACH_BITS + 1 & mask]


def _span() -> list:
    """``first`` and ``last``, where an anchor's strings begin."""
    pos, mask = F.shiftright("spot", 2 * _REACH_BITS + 1), (1 << _REACH_BITS) - 1
    return [(pos - F.shiftright("spot", _REACH_BITS + 1).bitwiseAND(F.lit(mask))).alias("first"), (pos - F.shiftright("spot", 1).bitwiseAND(F.lit(mask))).alias("last")]


def _dealt(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are dealt anew, so that Spark can split a frequent key.

    Where a side is an aggregation by the same columns, Spark would keep its
    dealing and could not; a hash of them as a key more prevents that.
    """
    hashed = lambda d: d.withColumn("_h", F.hash(*on))
    return hashed(a).join(hashed(b), [*on, "_h"], how).drop("_h")


def _anchors_again(rows: DataFrame) -> DataFrame:
    """Anchors that occur in two places or more, one row each.

    A place is a text's digest with a place in it, so copies of a text that
    different tasks met are in one place.
    """
    text = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long").alias("text")
    each = rows.filter("first").select("rid", text, F.inline(F.arrays_zip(*_LONGS[:4]))).withColumnsRenamed({"anchors": "kh", "spots": "spot"})
    each = each.withColumn("place", F.xxhash64("text", "spot")).drop("text")
    again = each.groupBy("kh").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("kh")
    return _dealt(each, again, ["kh"])


def _runs(found: DataFrame) -> DataFrame:
    """Classes of equal runs: one of each, whether it is ``alone``, and whether it is in two places."""
    got = found.groupBy("kh", "d1", "d2").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max(F.col("spot").bitwiseAND(F.lit(1))).alias("again"), F.min(F.struct("rid", "spot")).alias("one"))
    return got.select("kh", "d1", "d2", "one.rid", "one.spot", (F.col("a") < F.col("b")).alias("several"), ((F.col("a") == F.col("b")) & (F.col("again") == 0)).alias("alone"))


def _classes(runs: DataFrame, hot: int) -> DataFrame:
    """Runs of anchors with several classes, one of them ``alone``; ``hot`` where they have very many."""
    counts = runs.groupBy("kh").agg(F.count("*").alias("m"), F.max("alone").alias("any")).filter("m > 1 and any").select("kh", (F.col("m") > hot).alias("hot"))
    return _dealt(runs, counts, ["kh"]).select("kh", "rid", "spot", "alone", "hot")


@cache
def _packer():
    """One per worker process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1)


_CONTEXT = "kh long, rid long, pos long, least int, most int, alone boolean, anchor int, context binary"
_SUFFIX = "kh long, rid long, first long, last long, alone boolean, block int, edge int, core binary, before binary, after binary"


def _at_anchors(chosen: DataFrame, places: DataFrame, folder: str, schema: str, one: Callable, words: int) -> DataFrame:
    """Rows that ``one`` makes of each text (and its codes) and anchor."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        rows, size = [], 0
        for b in batches:
            listed = b.column("found")
            where = zip(*(b.column(c).to_pylist() for c in ("rid", "at", "packed")), strict=True)
            for i, text in enumerate(texts_at(folder, where)):
                rid, found = b.column("rid")[i].as_py(), listed[i].values
                kh, spot, alone = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                text = (text, *word_codes(text)) if words else text
                for k, pos, least, most, a in zip(*(x.tolist() for x in (kh, *_anchor(spot), alone)), strict=True):
                    for row, weight in one(text, pos, least, most, a):
                        rows.append((k, rid, *row))
                        size += weight
                    if size > BATCH_BYTES:
                        yield make()
                        rows, size = [], 0
        if rows:
            yield make()

    listed = chosen.groupBy("rid").agg(F.collect_list(F.struct("kh", "spot", "alone")).alias("found"))
    return by_archive(listed.join(places, "rid")).select("rid", "at", "packed", "found").mapInArrow(run, schema)


def _surroundings(chosen: DataFrame, places: DataFrame, folder: str, words: int) -> DataFrame:
    """Packed contexts of anchors; those of words begin and end with a word."""
    length = _length(words)

    def one(text: bytes | tuple, pos: int, least: int, most: int, alone: bool) -> Iterator[tuple[tuple, int]]:
        start, end = max(0, pos - (most // BLOCK * BLOCK + BLOCK - 1)), pos - least // BLOCK * BLOCK + length
        if words:
            text, _, begins, ends = text
            a, b = start // WORD, min(-(-end // WORD), len(ends))
            start, cut = a * WORD, _packer().compress(text[begins[a] : ends[b - 1]])
        else:
            cut = _packer().compress(text[start:end])
        yield (pos, least, most, alone, pos - start, cut), len(cut) + 100

    return _at_anchors(chosen, places, folder, _CONTEXT, one, words)


REPEATS = "rid long, first long, last long"


def _sorted_repeats(contexts: DataFrame, words: int) -> DataFrame:
    """Repeats among contexts, anchor by anchor."""
    length = _length(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held: list = []
        size = 0

        def solve(rows: list) -> pa.RecordBatch:
            kh, rid, pos, least, most, alone, anchor, context = zip(*rows, strict=True)
            context = [unpack.decompress(c) for c in context]
            context = [word_codes(c)[0] for c in context] if words else context
            kh, rid, pos, least, most, anchor = (np.array(x, np.int64) for x in (kh, rid, pos, least, most, anchor))
            entry, lo, hi = repeated_in_groups(kh, context, anchor, least, most, np.array(alone, bool), length)
            spans = merged(np.unique(rid, return_inverse=True)[1][entry], pos[entry] - hi, pos[entry] - lo)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.unique(rid)[spans[0]], *spans[1:])], names=["rid", "first", "last"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += row[4] - row[3] + length  # unpacked
        if held:
            yield solve(held)

    return contexts.repartition("kh").sortWithinPartitions("kh", "rid", "pos").mapInArrow(run, REPEATS)


# --------------------------------------------------- anchors of very many classes


def _suffixes(chosen: DataFrame, places: DataFrame, folder: str, words: int) -> DataFrame:
    """Cores of anchors' blocks, each with what surrounds it."""
    length = _length(words)

    def one(text: bytes | tuple, pos: int, least: int, most: int, alone: bool) -> Iterator[tuple[tuple, int]]:
        text = text[1] if words else text
        for block in range(least // BLOCK, most // BLOCK + 1):
            core = pos - BLOCK * block
            lo, hi = max(BLOCK * block, least), min(BLOCK * block + BLOCK - 1, most)
            end = core + length - BLOCK + 1
            yield (pos - hi, pos - lo, alone, block, core, text[core:end], text[max(0, core - BLOCK + 1) : core], text[end : end + BLOCK - 1]), 2 * length

    return _at_anchors(chosen, places, folder, _SUFFIX, one, words)


_EDGE = "c1 long, c2 long, rid long, first long, last long, alone boolean, edge int, before binary, after binary"


def _ranged_repeats(suffixes: DataFrame) -> DataFrame:
    """Repeats among suffixes, sorted by ranges; a frequent core is in no task as a whole after that.

    Two strings that hold one core at one place are equal if what they have
    of its surroundings is, so only that is grouped, by its bytes.
    """
    keys = ("kh", "block", "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _EDGE.split(", ")]
        before, held = None, None  # the core above; its first row, until a second is found
        for b in batches:
            out = []
            for r in b.to_pylist():
                core = tuple(r[k] for k in keys)
                row = (r["rid"], r["first"], r["last"], r["alone"], r["edge"], r["before"], r["after"])
                if core != before:
                    name = np.frombuffer(hashlib.blake2b(core[2], digest_size=16, key=f"{core[0]}:{core[1]}".encode()).digest(), np.int64).tolist()
                    before, held = core, row
                    continue
                if held is not None:
                    out.append((*name, *held))
                    held = None
                out.append((*name, *row))
            if out:
                types = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    ranged = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, _EDGE)
    edges = staging.stage(ranged, "shared-cores")
    hull = ["c1", "c2", "before", "after"]
    hulls = edges.groupBy(*hull).agg(F.count("*").alias("n"))
    of = edges.join(hulls, hull)
    whole = of.filter("n > 1 and alone").select("rid", "first", "last")
    # one of each surrounding, string by string: what it has before and after the core
    one = edges.groupBy(*hull).agg(F.count("*").alias("n"), F.min(F.struct("rid", "first", "last", "alone", "edge")).alias("r")).select(*hull, "n", "r.*")
    each = one.withColumn("at", F.explode(F.sequence("first", "last"))).withColumn("j", (F.col("edge") - F.col("at")).cast("int"))
    each = each.withColumn("said", F.concat(F.expr("substring(before, length(before) - j + 1, j)"), F.expr(f"substring(after, 1, {BLOCK - 1} - j)")))
    string = ["c1", "c2", "j", "said"]
    each = each.select(*string, "rid", "at", (F.col("alone") & (F.col("n") == 1)).alias("alone"))
    strings = each.groupBy(*string).agg(F.count("*").alias("m"), F.max("alone").alias("any")).filter("m > 1 and any").select(*string)
    edge = each.filter("alone").join(strings, string).select("rid", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionByName(edge)


# --------------------------------------------------------------------- all texts


def find_repeats(docs: DataFrame, keep: list[str], hot: int = HOT, words: int = 0) -> tuple[DataFrame, str]:
    """Rows of ``docs`` with their text's place and ``spans`` of repeats.

    ``own_first``, ``own_last`` and ``spans`` list first and last begins of
    repeated strings in no order; ``copies`` counts the rows of equal text;
    ``kept`` holds the columns ``keep``.  With ``words``, strings are those of
    the codes of so many words.
    """
    spark = docs.sparkSession
    staging.ship(spark)
    folder = staging.new_path(spark, "texts")
    files.make_folder(folder)
    rows = staging.stage(read_texts(docs, folder, keep, words), "text-rows")
    shas = rows.groupBy("sha").agg(F.count("*").alias("copies")).filter("copies > 1")
    found = staging.stage(_anchors_again(rows), "anchors-again")
    runs = staging.stage(_runs(found), "runs")
    several = _dealt(found, runs.filter("several").select("kh", "d1", "d2"), ["kh", "d1", "d2"]).select("rid", *_span())
    classes = staging.stage(_classes(runs, hot), "classes")
    places = rows.select("rid", "at", "packed")
    contexts = _surroundings(classes.filter("not hot"), places, folder, words)
    sorted_ = _sorted_repeats(contexts, words)
    ranged = _ranged_repeats(_suffixes(classes.filter("hot"), places, folder, words))
    spans = several.unionByName(sorted_).unionByName(ranged)
    spans = staging.stage(spans.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    out = _dealt(rows.drop(*_LONGS[:4], "first"), shas, ["sha"], "left").join(spans, "rid", "left")
    return out.withColumn("copies", F.coalesce("copies", F.lit(1))), folder


def _spans_of(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last begins of row ``i``'s repeated strings, in order."""
    first, last = ([b.column(c)[i].values] for c in ("own_first", "own_last"))
    if b.column("spans")[i].is_valid:
        more = b.column("spans")[i].values
        first.append(more.field(0))
        last.append(more.field(1))
    first, last = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in xs]) for xs in (first, last))
    return merged(np.zeros(len(first), np.int64), first, last)[1:]


def covered(n: int, copies: int, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated strings, beginning at merged spans, cover."""
    if copies > 1:
        return [(0, n)] if n >= LENGTH else []
    _, first, last = merged(np.zeros(len(first), np.int64), first, last + LENGTH - 1)
    return list(zip(first.tolist(), (last + 1).tolist(), strict=True))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, keep: list[str], text: bool = False, hot: int = HOT) -> DataFrame:
    """Columns ``keep`` with digests of what stays, and ``kept``, its text, if asked for.

    A character that a repeat begins or ends inside of is left out of ``kept``.
    """
    from pyspark.sql.types import StructType

    found, folder = find_repeats(docs, keep, hot)
    made = StructType.fromDDL(RESULT + ", kept_text string" * text)
    schema = StructType([found.schema["kept"], *made])
    changed = F.lit(True) if text else (F.col("spans").isNotNull() | (F.size("own_first") > 0)) & (F.col("copies") == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("n_bytes", "sha", "copies", "rid", "at", "packed")), strict=True))
                runs = [covered(n, copies, *_spans_of(part, k)) for k, (n, _, copies, *_) in enumerate(rows)]
                gone = [sum(y - x for x, y in cut) for cut in runs]
                read = texts_at(folder, (r[3:] for r, g in zip(rows, gone, strict=True) if text or 0 < g < r[0]))
                out: list = []
                for (n, sha, *_), cut, g in zip(rows, runs, gone, strict=True):
                    whole = next(read) if text or 0 < g < n else b""
                    left = whole if not g else b"".join(whole[x:y] for x, y in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), n], strict=True))
                    out.append((n, g, len(cut), hashlib.sha256(left).hexdigest() if g else sha.hex(), left.decode("utf-8", "ignore") if text else None))
                arrays = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[: len(made)], [pa.int64()] * 3 + [pa.string()] * 2, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("kept"), *arrays], names=["kept", *made.names])

    chosen = by_archive(found.filter(changed)).select("kept", "n_bytes", "sha", "copies", "own_first", "own_last", "spans", "rid", "at", "packed")
    out = chosen.mapInArrow(run, schema)
    if not text:
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
        rest = found.filter(~changed).select("kept", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
        out = out.unionByName(rest)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    stay = [F.col("kept").getField(c).alias(c) for c in keep if c not in [*names, *(["kept"] * text)]]
    return out.select(*stay, *names, *([F.col("kept_text").alias("kept")] * text))


def without_passages(text: bytes, copies: int, first: np.ndarray, last: np.ndarray, words: int) -> bytes:
    """What stays of a text; ``first`` and ``last`` are of merged spans of its codes."""
    if copies == 1 and not len(first):
        return text
    _, begins, ends = word_codes(text)
    if copies > 1:
        runs = [(0, len(ends))] if len(ends) >= words else []
    else:
        a, b = -(-first // WORD), last // WORD
        runs = [(x, y + words) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x <= y]  # begins inside a word aside
    out, at = [], 0
    for x, y in runs:
        if begins[x] > at and not (out and text[at : begins[x]].isspace()):
            out.append(text[at : begins[x]])
        at = max(at, int(ends[y - 1]))
    return b"".join([*out, text[at:]])


def remove_passages(docs: DataFrame, keep: list[str], words: int, hot: int = HOT) -> DataFrame:
    """Columns ``keep`` and ``kept``, the text without any passage of ``words`` words or more that repeats."""
    from pyspark.sql.types import StringType, StructField, StructType

    found, folder = find_repeats(docs, keep, hot, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = b.column("copies").to_pylist()
            texts = texts_at(folder, zip(*(b.column(c).to_pylist() for c in ("rid", "at", "packed")), strict=True))
            out, size, start = [], 0, 0
            for i, t in enumerate(texts):
                out.append(without_passages(t, copies[i], *_spans_of(b, i), words).decode())
                size += len(t)
                if size > PORTION or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("kept").slice(start, len(out)), pa.array(out, pa.string())], names=["kept", "left"])
                    out, size, start = [], 0, i + 1

    chosen = by_archive(found).select("kept", "copies", "own_first", "own_last", "spans", "rid", "at", "packed")
    out = chosen.mapInArrow(run, StructType([found.schema["kept"], StructField("left", StringType())]))
    return out.select(*(F.col("kept").getField(c).alias(c) for c in keep if c != "kept"), F.col("left").alias("kept"))
