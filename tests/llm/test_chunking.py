import hashlib
import random

import numpy as np
from helpers import ODD, documents

from lodekey.llm import chunking as ch


def plain_ends(raw):
    """Chunk ends by a hash rolled byte by byte."""
    gear = ch.gear_table().tolist()
    ends, start, h = [], 0, 0
    window: list = []
    for i, b in enumerate(raw):
        window = (window + [b])[-32:]
        h = sum(gear[x] << (len(window) - 1 - k) for k, x in enumerate(window)) % (1 << 32)
        size = i + 1 - start
        bits = ch.RARE_BITS if size <= ch.NORMAL else ch.COMMON_BITS
        if size == ch.MAX or (size >= ch.MIN and h >> (32 - bits) == 0):
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(raw)] if start < len(raw) else [])


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_chunks_are_those_of_the_plain_rule():
    r = random.Random(1)
    for raw in [b"", b"a", b"z" * 2000, *(prose(r, n).encode() for n in (3, 10, 100, 900)), bytes(r.randrange(256) for _ in range(5000))]:
        assert ch.chunk_ends(raw) == plain_ends(raw)


def test_shifts_change_few_chunks():
    r = random.Random(2)
    raw = prose(r, 2000).encode()
    shifted = raw[:3000] + b"some more words" + raw[3000:]
    a, b = ch.chunk_set(raw), ch.chunk_set(shifted)
    assert ch.containment(a, b) > 0.95
    assert ch.containment(a, ch.chunk_set(prose(r, 2000).encode())) < 0.02


def test_documents(spark):
    r = random.Random(3)
    texts = [*ODD, *(prose(r, r.randint(0, 400)) for _ in range(40))]
    got = {x.doc_id: x for x in ch.fingerprint_documents(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        text, nxt = texts[i] or "", texts[(i - 1) % len(texts)] or ""
        half = len(text) // 2
        edited = (text[: len(text) - half] + nxt[:half]).encode()
        x = got[i]
        own, changed, other = (ch.chunk_set(t) for t in (text.encode(), edited, nxt.encode()))
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (ch.fingerprint(own), ch.fingerprint(changed))
        assert (x.near_edited, x.near_next) == (ch.containment(own, changed), ch.containment(own, other))
    assert got[9].fingerprint == got[10].fingerprint
    assert np.mean([x.near_edited for x in got.values() if x.n_chars > 500]) > 0.3


def test_ties_null_ids_and_empty_tables(spark):
    rows = ch.fingerprint_documents(documents(spark, ["b", "a", "c", "d" * 9], ids=[1, 1, None, 0])).collect()
    nxt = {(x.doc_id, x.n_chars): x.edited_sha256 for x in rows}
    assert len(rows) == 4
    assert nxt[0, 9] == hashlib.sha256(b"dddddc").hexdigest()
    only = ch.fingerprint_documents(documents(spark, ["xy" * 50], ids=[3])).collect()
    assert only[0].near_next == 1.0
    assert ch.fingerprint_documents(documents(spark, [])).collect() == []
