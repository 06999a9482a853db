import random

from helpers import ODD, documents

from lodekey.llm import simhash


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each(texts, least=0.8):
    sets, parent = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or len(s & sets[j]) >= least * len(s | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def test_pipeline_stage_drops_all_of_similarity_four_fifths(spark):
    import corpus_pipeline as cp

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    texts = list(ODD)
    for i in range(12):
        base = [word() for _ in range(100)]
        texts.append(" ".join(base))
        for edits in range(1, 5):  # 0.9 to 0.65
            other = list(base)
            for k in range(edits):
                other[15 + 20 * k] = word()
            texts.append(" ".join(other))
        if i == 0:  # a larger group of near copies
            for k in range(40):
                texts.append(" ".join([*base[:k], word(), *base[k + 1 :]]))
    docs = documents(spark, texts).select(*cp.COLUMNS)
    got = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(x.doc_id for x in got) == first_of_each(texts)
    assert all(x.text == texts[x.doc_id] for x in got)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    d = documents(spark, ["a b c d", "a b c d", "A b c  d", "other text here now"], ids=[5, 5, None, None]).select("doc_id", "text")
    assert sorted(((x.doc_id, x.text) for x in simhash.one_per_component(d).collect()), key=str) == [(5, "a b c d"), (None, "other text here now")]
    assert simhash.one_per_component(documents(spark, [])).collect() == []
