import hashlib
import random

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from lodekey.llm import suffixes as sx
from lodekey.llm.rolling import prefix_sums


def plain(texts):
    """(bytes removed, spans, digest of what stays) of each text."""
    count: dict = {}
    for t in texts:
        for i in range(len(t) - 399):
            count[t[i : i + 400]] = count.get(t[i : i + 400], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(58), prose(70), prose(200), prose(57)[:400], prose(57)[:399], "ab" * 400]
    texts = [None, "", "x", prose(400), "y" * 1500, "y" * 399, "y" * 400, ("line of text, " * 40) * 3]
    for _ in range(40):
        parts = [prose(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.choice([0, 0, 1, 5, 40])
            parts += [s[cut:], prose(r.randint(0, 30))]
        texts.append(r.choice(["", " "]).join(parts))
    base = prose(300).split()
    for _ in range(8):
        edited = list(base)
        for _ in range(r.randint(0, 4)):
            edited[r.randrange(300)] = word()
        texts.append(" ".join(edited))
    texts += [texts[10], texts[10], "short", "short", prose(2000)]
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (1, 3), (2, 1), (3, 1)])
def test_documents(spark, seed, hot):
    texts = corpus(seed)
    want = plain([(t or "").encode() for t in texts])
    got = {r.doc_id: r for r in sx.remove_repeats(documents(spark, texts), ["doc_id"], hot=hot).collect()}
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_texts_come_back(spark):
    texts = corpus(3)
    got = sx.remove_repeats(documents(spark, texts), ["doc_id", "lang"], text=True).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.n_removed == 0:
            assert r.kept == (texts[r.doc_id] or "")
        else:
            assert len(r.kept.encode()) <= r.n_bytes - r.n_removed
        assert r.lang == "en"


def plain_passages(texts, n=51):
    """Which words of each text are in a passage of ``n`` that occurs again."""
    count: dict = {}
    split = [(t or "").split(" ") if t else [] for t in texts]
    split = [[w for w in ws if w] for ws in split]
    for ws in split:
        for i in range(len(ws) - n + 1):
            count[tuple(ws[i : i + n])] = count.get(tuple(ws[i : i + n]), 0) + 1
    out = []
    for ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if count[tuple(ws[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append([w for w, g in zip(ws, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_passages_of_words(spark, hot):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(n))
    shared = [prose(50), prose(51), prose(51), prose(80), "x " * 60]
    assert all(len(s.encode()) < 400 for s in shared)
    texts = [None, "", " ", "x", shared[1], prose(400)]
    for _ in range(60):
        parts = [prose(r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared).replace(" ", r.choice([" ", "  "])), prose(r.randint(1, 30))]
        texts.append(" ".join(parts))
    texts += [texts[9], texts[9]]
    want = plain_passages(texts)
    got = {x.doc_id: x.kept for x in sx.remove_passages(documents(spark, texts), ["doc_id"], 51, hot=hot).collect()}
    assert [got[i].split() for i in range(len(texts))] == want
    assert got[5] == texts[5]


def test_words_of_scripts_without_blanks():
    text = " ab\t漢字 é漢x\n".encode()
    codes, begins, ends = sx.word_codes(text)
    assert [text[a:b].decode() for a, b in zip(begins, ends, strict=True)] == ["ab", "漢", "字", "é", "漢x"]
    assert codes == b"".join(sx.word_codes(w.encode())[0] for w in ("ab", "漢", "字", "é", "漢x"))


def test_repeated_rows_and_empty_tables(spark):
    d = documents(spark, ["z" * 10 + "long " * 100, "z" * 10 + "long " * 100], ids=[1, 1])
    assert [(r.n_removed, r.n_spans) for r in sx.remove_repeats(d, ["doc_id"]).collect()] == [(510, 1)] * 2
    assert sx.remove_repeats(documents(spark, []), ["doc_id"]).collect() == []
    assert sx.remove_repeats(documents(spark, []), ["doc_id"], text=True).collect() == []


def test_kept_columns_of_any_name(spark):
    names = ["rid", "at", "copies", "owner", "spans", "kept", "first", "n_removed", "sha", "a b"]
    d = documents(spark, corpus(4)[:20]).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for r in sx.remove_repeats(d, ["doc_id", *names]).collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n != "n_removed")
        assert isinstance(r.n_removed, int)
    assert {r.rid for r in sx.remove_passages(d, ["rid", "spans"], 51).collect()} == {f"rid{i}" for i in range(20)}


def test_sorted_suffixes():
    r = random.Random(5)
    text = "".join(r.choice("ab") for _ in range(900)).encode() + b"a" * 200
    data = np.frombuffer(text, np.uint8)
    at = np.arange(0, 1000, 3)
    group = np.sort(np.array([r.randrange(5) for _ in at]))
    order = sx.sort_suffixes(data, prefix_sums(data), at, group, 90)
    want = sorted(range(len(at)), key=lambda i: (group[i], text[at[i] : at[i] + 90], i))
    assert order.tolist() == want
    a, b = at[:-1], at[1:]
    got = sx.common_extension(prefix_sums(data), a, b, 90)
    assert got.tolist() == [next((n for n in range(90) if text[x + n] != text[y + n]), 90) for x, y in zip(a, b, strict=True)]


def test_anchors_are_those_of_the_string():
    r = random.Random(6)
    s = bytes(r.randrange(256) for _ in range(500))
    texts = [bytes(r.randrange(256) for _ in range(n)) + s + bytes(r.randrange(256) for _ in range(m)) for n, m in ((0, 0), (7, 900), (3000, 1))]
    text, pos, kh, lo, hi, *_ = sx.find_anchors(texts)[0]
    for t, n in zip(range(3), (0, 7, 3000), strict=True):
        mine = [(k, p - n) for i, k, p, a, b in zip(text, kh, pos, lo, hi, strict=True) if i == t and a <= n + 50 <= b]
        assert len(mine) == 1
        assert mine == [(k, p) for i, k, p, a, b in zip(text, kh, pos, lo, hi, strict=True) if i == 0 and a <= 50 <= b]


def test_collisions_are_told_apart():
    data = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    same = np.zeros(4, np.int64)
    assert sx._again(data, [same], np.array([0, 4, 8, 12]), np.full(4, 4)).tolist() == [True, False, True, False]


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(9)
    part = bytes(r.randrange(97, 123) for _ in range(3000))
    texts = [part, b"q" * 2500 + part[700:2400] + b"ab" * 900 + part[:1900], b"short", b"", part[100:]]
    whole = sx.find_anchors(texts)
    for stretch in (300, 777, 4096):
        monkeypatch.setattr(sx, "STRETCH", stretch)
        got = sx.find_anchors(texts)
        assert [a.tolist() for a in got] == [a.tolist() for a in whole]
    assert whole[1].size  # strings that one text holds twice


def test_memory_for_a_long_text():
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 6 << 20, np.uint8).tobytes()
    sx.find_anchors([text[:500_000]])
    tracemalloc.start()
    found, _ = sx.find_anchors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape[1] > 30_000
    assert peak < 80 << 20
    periodic, own = sx.find_anchors([b"abc" * (1 << 19)])
    assert periodic.shape[1] <= 12  # equal runs of one text are one
    assert own[1, 0] == 0
    assert own[2, -1] == 3 * (1 << 19) - 400


def test_an_anchor_in_over_a_thousand_places(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(75))
    texts = [" ".join([*(word() for _ in range(4)), passage, *(word() for _ in range(4))]) for _ in range(1100)]
    want = plain([t.encode() for t in texts])
    got = {x.doc_id: x for x in sx.remove_repeats(documents(spark, texts), ["doc_id"]).collect()}
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
