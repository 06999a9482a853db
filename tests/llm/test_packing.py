import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents
from tokenizers import Tokenizer

from lodekey.llm import packing, wordtokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_tight_and_gapless(seed):
    r = random.Random(seed)
    capacity, n = r.choice([7, 30, 100, 4096]), r.choice([1, 2, 50, 3000])
    lengths = [r.randint(1, capacity) if r.random() < 0.3 else min(capacity, 1 + int(r.expovariate(6 / capacity))) for _ in range(n)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.Plan(counts, capacity)
    length = np.repeat(sorted(counts), [counts[x] for x in sorted(counts)])
    rank = np.concatenate([np.arange(counts[x]) for x in sorted(counts)])
    bins: dict = {}
    for x, s, o in zip(length.tolist(), *(a.tolist() for a in plan.places(length, rank)), strict=True):
        bins.setdefault(s, []).append((o, x))
    large = 0
    for items in bins.values():
        end = 0
        for o, x in sorted(items):
            assert o == end
            end += x
        assert end <= capacity
        large = max(large, sum(3 * x > capacity for _, x in items))
    assert large <= 2
    assert len(bins) == plan.sequences
    assert len(bins) <= 11 / 9 * -(-sum(lengths) // capacity) + sum(2 * x > capacity for x in lengths) + 1


def test_ids_are_the_librarys():
    library = Tokenizer.from_file(VOCABULARY)
    texts = [t or "" for t in ODD] + ["İstanbul ΑΣ ΟΔΟΣ. ẞ", "<|endoftext|> a<|startoftext|>", "ét́ Å", "it's I'LL 12 34.5 !!?", "a\x1cb\xa0c d", "日本語 テスト", "aaaa" * 40, "Don't stop'n'go 'sabc"]
    got = wordtokens.WordTokens(VOCABULARY, most=5).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark):
    texts = [*ODD, "word " * 9000]
    library = Tokenizer.from_file(VOCABULARY)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    rows = packing.pack_documents(documents(spark, texts), VOCABULARY).collect()
    for i, want in enumerate(ids):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in mine] == [4096] * (len(want) // 4096) + [len(want) % 4096] * (len(want) % 4096 > 0)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    assert len({r.sequence_id for r in rows}) == -(-sum(map(len, ids)) // 4096)


def test_repeated_rows_and_empty_tables(spark):
    rows = packing.pack_documents(documents(spark, ["a b"] * 50, ids=[3] * 50), VOCABULARY).collect()
    assert sorted(r.offset for r in rows) == [3 * i for i in range(50)]
    assert packing.pack_documents(documents(spark, []), VOCABULARY).collect() == []


def test_numbers_are_gapless(spark):
    d = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 50 end k")
    got: dict = {}
    for r in packing.number_within(d, "k", ["id"], "n").collect():
        got.setdefault(r.k, []).append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert sum(map(len, got.values())) == 5000
