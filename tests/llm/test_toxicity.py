import random
import zlib

import numpy as np
from helpers import documents

from lodekey.llm import toxicity as tox

CLEAN = [a + b for a in ("tor", "mel", "sin", "kra", "vo", "pel") for b in ("an", "ith", "os", "er", "ulim", "da", "enko")]


def corpus(n, seed=1):
    """Invented prose, a fifth of it with forms of two insulting stems."""
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [r.choice(CLEAN) for _ in range(r.randint(20, 90))]
        bad = r.random() < 0.2
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words))] = r.choice(["grublo", "snivvet"]) + r.choice(["", "ik", "ak", "om", "ulla", "eb"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_gradients():
    w = tox.Words(["one two three four five six", "grublo two grublik"])
    net = tox.Network(3)
    r = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = (net.p[k] + r.standard_normal(net.p[k].shape) * 0.1).astype(np.float64)

    def loss():
        x = net.inputs(w).astype(np.float64)
        return net.forward(net.gates(x), w.windows(8, 4)[0]).sum()

    x = net.inputs(w)
    at = w.windows(8, 4)[0]
    logit, kept = net.forward(net.gates(x), at, keep=True)
    g = net.backward(w, x, kept, np.ones(len(logit), np.float32))
    for k in ("out", "attend", "state", "inner", "input", "bias", "words", "grams"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-2
        up = loss()
        net.p[k][i] = old - 1e-2
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-2 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3, k


def test_windows_cover_every_word():
    w = tox.Words([" ".join(["w"] * n) for n in (0, 1, 31, 32, 33, 56, 57, 200)])
    at, text = w.windows()
    for i in range(8):
        mine = at[text == i]
        assert set(mine[mine < len(w.word)].tolist()) == set(range(w.first[i], w.first[i + 1]))


def test_held_out_accuracy():
    texts, labels = corpus(500)
    net = tox.train(texts[:350], labels[:350])
    predicted = net.scores(texts[350:]) >= tox.THRESHOLD
    assert (predicted == np.array(labels[350:], bool)).mean() > 0.95
    assert net.scores([" ".join(CLEAN[i % 42] for i in range(400)) + " snivvetom"])[0] >= tox.THRESHOLD  # whole texts


def test_tables(spark):
    texts, labels = corpus(260)
    texts += [None, "", "...", texts[0]]
    docs = documents(spark, texts)
    lab = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(0, 1, labels[0]), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    net = tox.fit(docs, lab)
    got = {r.doc_id: r for r in tox.score_documents(docs, net).withColumn("held_out", tox.held_out(tox.F.col("doc_id"))).collect()}
    assert len(got) == len(texts)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].score < 0.01 for i in range(260, 263))
    assert abs(got[0].score - got[263].score) < 1e-6
    kept = tox.drop_toxic(docs.select("doc_id", "text", "lang", "source", "n_chars"), lab)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < tox.THRESHOLD}
    assert tox.score_documents(documents(spark, []), net).collect() == []


def test_without_labels(spark):
    docs = documents(spark, ["a b", None])
    assert tox.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert [r.score for r in tox.score_documents(docs, None).collect()] == [0.0, 0.0]
