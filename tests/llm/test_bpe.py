import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD, documents

from lodekey.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.shared(PATH, PATTERN)


def test_texts(encoder, library):
    texts = [t or "" for t in ODD] + ["don't I'll  two   spaces \n\n x\t y ", "日本語 テスト １２", "<|endoftext|>", "a\x1cb\xa0c", "'s's 'S", "1234567 x2y", "…—“quoted”", "ﬁ ẞ Ώ"]
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(t)
        assert encoder.decode(raw) == t.encode()


def test_random_pieces(encoder, library):
    r = random.Random(5)
    for _ in range(300):
        raw = "".join(r.choice("abcdeëß eth ing the") for _ in range(r.randint(1, 40)))
        assert encoder.pairs.encode_piece(raw.encode()) == library._encode_single_piece(raw.encode())


def test_appends_and_edits(encoder, library):
    r = random.Random(6)
    piece = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    table = bpe.PrefixTable(encoder.pairs, piece(400))
    for _ in range(30):
        table.append(piece(r.randint(0, 5)))
        start = r.randint(0, len(table.raw))
        stop = min(len(table.raw), start + r.randint(0, 6))
        done = table.replace(start, stop, piece(r.randint(0, 6)))
        assert table.ids() == library._encode_single_piece(table.raw)
        assert done <= len(table.raw)


def test_documents(spark, library):
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(spark, ODD), PATH, PATTERN, ids=True).collect()}
    for i, t in enumerate(ODD):
        want = library.encode_ordinary(t or "")
        assert rows[i].ids == want
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(documents(spark, []), PATH, PATTERN).collect() == []
