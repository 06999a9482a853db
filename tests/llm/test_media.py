import hashlib
import io
import zlib
from contextlib import contextmanager

import numpy as np
import pytest
from helpers import ODD, documents

from lodekey.llm import files, media, staging


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 9, b"x" * 64, b"y" * 65])
def test_images_are_lossless(raw):
    payload = media.pad(raw)
    assert len(payload) % 64 == 0
    assert len(payload) >= 64
    assert media.from_png(media.to_png(payload)).tobytes() == payload
    assert media.feature(np.frombuffer(payload, np.uint8).reshape(-1, 64)) == media.feature(media.from_png(media.to_png(payload)))


def test_documents(spark):
    rows = {r.doc_id: r for r in media.media_columns(documents(spark, ODD)).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        payload = media.pad((t or "").encode())
        png = media.to_png(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len((t or "").encode()), len(payload), len(png))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(png).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[9].feature == rows[10].feature


def test_small_ranges_give_each_member_once(spark):
    folder = staging.new_path(spark, "media")
    files.make_folder(folder)
    staging.stage(media.write_archives(documents(spark, [f"text {i} " * (i % 9) for i in range(60)]), folder), "archives")
    got = media.read_archives(spark, folder, range_bytes=100).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(60))


def test_empty_tables(spark):
    assert media.media_columns(documents(spark, [])).collect() == []


def test_members_are_retried_alone():
    good = b"".join(media.member({"doc_id": i, "n_bytes": 3}, bytes([i]) * 50) for i in range(4))
    second = good.index(media.MARK, 1)
    opened = []

    @contextmanager
    def flaky(path):
        opened.append(path)
        raw = bytearray(good)
        if len(opened) < 3:
            raw[second + 60] ^= 1
        yield io.BytesIO(bytes(raw))

    got = list(media.members("x", 0, len(good), opened=flaky))
    assert [h["doc_id"] for _, h, _ in got] == [0, 1, 2, 3]
    assert len(opened) == 3
    opened.clear()

    @contextmanager
    def broken(path):
        raw = bytearray(good)
        raw[second + 60] ^= 1
        yield io.BytesIO(bytes(raw))

    with pytest.raises(ValueError):
        media.read_member(broken, "x", second, retries=1, wait=0)
