import random
import re

import numpy as np
import xxhash
from helpers import ODD, documents
from pyspark.sql import functions as F

from lodekey.llm import simhash
from lodekey.llm import shingles
from lodekey.llm import similar
from lodekey.llm.components import components
from lodekey.llm.shingles import shingle_hashes


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def classes(fps, distance=4):
    """The smallest index linked to each."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_long_texts_are_read_in_chunks(monkeypatch):
    r = random.Random(3)
    texts = [" ".join("x" * r.randint(1, 9) for _ in range(n)) for n in (3, 4, 5, 300)]
    whole = [shingle_hashes(t, 4).tolist() for t in texts]
    for chunk in (1, 7, 50):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        assert [shingle_hashes(t, 4).tolist() for t in texts] == whole


def test_fingerprints():
    for t in [*ODD, "A b C d E", "\x1c a\x0bb\x85c d e f", "x " * 500]:
        assert simhash.simhash(shingle_hashes(t or "", 4)) == plain(t)


def test_links_of_random_bits(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for d in (1, 2, 3, 4, 5):
            fps.append(f ^ sum(1 << i for i in r.sample(range(64), d)))
    fps = sorted(set(fps) | {0, (1 << 64) - 1, 7})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    for segments in (2, 3, 4):
        assert {(x.u, x.v) for x in simhash.links(df, 4, segments).collect()} == want


def test_documents(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    texts = list(ODD)
    for _ in range(15):
        base = [word() for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(4):
            base[r.randrange(60)] = word()
            texts.append(" ".join(base))
    want = classes([plain(t) for t in texts])
    got = {x.doc_id: x for x in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == [plain(t) for t in texts]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    d = documents(spark, ["a b c d", "a b c d", "a b c d", "other text here now"], ids=[5, 5, None, None]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(d).collect()), key=str) == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert sorted((x.doc_id for x in simhash.one_per_component(d).collect()), key=str) == [5, None]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2001)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long").withColumn("x", F.lit(1))).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000 + i: 1000 for i in range(200)} | {2000: 2000, 2001: 2000}


def edited_copies(seed, n, words=150):
    """Copies of one text with none to twelve words changed; most pairs share under four fifths of their shingles."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, out = [word() for _ in range(words)], []
    for _ in range(n):
        text = list(base)
        for _ in range(r.randint(0, 12)):
            text[r.randrange(words)] = word()
        out.append(" ".join(text))
    return out


def test_pairs_of_a_group_that_are_not_similar(spark, monkeypatch):
    n, compared = 300, []
    texts = edited_copies(7, n)
    sets = [similar.shingles(t, 5) for t in texts]
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if similar.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    verified = similar.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(similar, "verified", counted)
    got = sorted(x.doc_id for x in simhash.one_per_component(documents(spark, texts)).select("doc_id").collect())
    assert got == sorted(set(group))
    assert len(got) > n // 10
    assert sum(compared) < 12 * n  # all pairs are 150 n


def test_rarest_shingles_find_all_similar_pairs(spark):
    r = random.Random(8)
    common = [r.getrandbits(63) for _ in range(60)]
    sets = [sorted({*r.sample(common, r.randint(0, 60)), *(r.getrandbits(63) for _ in range(r.randint(0, 12)))}) for _ in range(150)]
    sets += [sorted({*r.sample(s, max(1, len(s) - r.randint(0, 8))), *(r.getrandbits(63) for _ in range(r.randint(0, 4)))}) for s in sets if s]
    sets += [s[:5] for s in sets if len(s) > 5] + [[1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 2, 3, 4, 6], [7]]
    c = [r.choice([i, 0, 1]) for i in range(len(sets))]
    rows = spark.createDataFrame([(i, c[i], len(s), s) for i, s in enumerate(sets)], "node long, c long, size int, set array<long>")
    rows = simhash._rarest(rows, 0.8).withColumns({"fp": F.lit(0).cast("long"), "mins": F.array(*[F.lit(0).cast("long")] * 12)})
    alike = lambda i, j: similar.similarity(np.array(sets[i], np.int64), np.array(sets[j], np.int64)) >= 0.8
    want = {(i, j) for j in range(len(sets)) for i in range(j) if c[i] != c[j] and alike(i, j)}
    found = {(x.u, x.v) for x in simhash._near(simhash._minor(rows), rows, 0.8, 18, 12).collect()}
    assert len(want) > 100
    assert want <= found
    assert all(c[i] != c[j] for i, j in found)
    led = {(x.u, x.v) for x in simhash._near(simhash._central(rows), rows, 0.8, 18, 12).collect()}
    assert led <= found
