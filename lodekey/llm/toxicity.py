"""Toxicity by a bidirectional gated recurrent network, trained in numpy.

A word is a vector of its own (by a hash of the word) beside the mean vector
of its four-byte grams, so unseen forms of a known stem are still known; words
of over ``LONGEST`` bytes are several.  Windows of words, each overlapping the
next by half, run through a gated recurrent layer in either direction;
attention weights pool its states and a logistic unit scores the window.  A
document's score is that of its highest window, and every window of the whole
text is scored.

All of the network is learned by gradient from small random numbers.  Vectors
of words and grams that few training texts hold stay zero; how many is counted
without their labels.  A document teaches its highest windows, several at
first and later one.

Training takes labelled rows up to ``MAX_TOXIC`` and ``MAX_CLEAN`` (the
first by a hash of ``doc_id``; texts of up to ``MAX_TRAIN_BYTES``), never
rows of the held-out fold.  It runs in one task, over that bounded sample.
The model has a fixed size and is broadcast.

Defined results: null, empty and wordless texts score 0;
repeated rows get equal scores, up to rounding; a null ``doc_id`` is not held out;
without labelled rows of both kinds every score is 0; repeated labels of a
document count once, the largest; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodekey.llm import staging
from lodekey.llm.rolling import mix, powers, prefix_sums

WINDOW, STRIDE = 32, 16
LONGEST = 24  # bytes of a word
HIDDEN, EMBED = 8, 8
BUCKETS = 1 << 16
GRAM = 4
THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 1000, 2000, 20_000
FOLDS, HELD_OUT = 4, 2
EPOCHS, BATCH_DOCS, RATE, TABLE_RATE, TOXIC_WEIGHT = 8, 64, 0.02, 0.01, 3.0
LEAST_TEXTS = 8  # that hold a word or gram with a vector; less where rows are few
AT_FIRST = 4  # windows of a document that teach in the first half

TABLES = ("words", "grams")

_WORD_BYTE = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


class Words:
    """Bucket numbers of the words of many texts, and of the words' grams."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n\n\n\n", np.uint8)
        is_word = _WORD_BYTE[data]
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            edge = np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        pieces = -(-(end - start) // LONGEST)
        whole_end, nth = np.repeat(end, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * LONGEST
        end = np.minimum(start + LONGEST, whole_end)
        down, total = powers(len(data))[1], prefix_sums(data)
        self.word = self._bucket((total[end] - total[start]) * down[start])
        wide = data.astype(np.uint32)
        at = np.flatnonzero(is_word[:-3] & is_word[1:-2] & is_word[2:-1] & is_word[3:])
        self.gram = self._bucket((wide[at] | wide[at + 1] << np.uint32(8) | wide[at + 2] << np.uint32(16) | wide[at + 3] << np.uint32(24)).astype(np.uint64))
        self.grams = np.maximum(np.minimum(end, whole_end - (GRAM - 1)) - start, 0)  # that begin in each word, one after the other
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.first = np.searchsorted(start, bounds)  # word of each text, then the number of words

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return (mix(h) >> np.uint64(48)).astype(np.int64)

    def windows(self, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (windows x words; beyond the text: the number of words), and each window's text."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - window) // stride) + 1)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.first[:-1][text] + nth * stride)[:, None] + np.arange(window)
        return np.where(at < self.first[1:][text][:, None], at, len(self.word)), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, in single precision."""

    def __init__(self, seed: int = 7):
        r, h, e = np.random.default_rng(seed), HIDDEN, 2 * EMBED
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "words": f(BUCKETS, EMBED, scale=0.1),
            "grams": f(BUCKETS, EMBED, scale=0.1),
            "input": f(e, 6 * h, scale=0.4),  # both directions' gates side by side
            "bias": np.zeros(6 * h, np.float32),
            "state": f(2, h, 3 * h, scale=0.3),
            "inner": np.zeros((2, 1, h), np.float32),
            "attend": f(2 * h, scale=0.5),
            "out": f(2 * h, scale=0.5),
            "offset": np.zeros(1, np.float32),
        }

    def inputs(self, w: Words) -> np.ndarray:
        """Vector of each word, and at the end that of no word (0)."""
        x = np.zeros((len(w.word) + 1, 2 * EMBED), np.float32)
        x[:-1, :EMBED] = self.p["words"][w.word]
        has = np.flatnonzero(w.grams)
        if len(has):
            n = w.grams[has]
            x[has, EMBED:] = np.add.reduceat(self.p["grams"][w.gram], np.cumsum(n) - n) / n[:, None].astype(np.float32)
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates; no word keeps the state as it is."""
        g = x @ self.p["input"] + self.p["bias"]
        for d in range(2):
            g[-1, (3 * d + 1) * HIDDEN : (3 * d + 2) * HIDDEN] = 40
        return g.reshape(len(x), 2, 3 * HIDDEN)

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at``; with ``keep`` also what backward() needs."""
        p, h, (n, size) = self.p, HIDDEN, at.shape
        xs = np.empty((size, 2, n, 3 * h), np.float32)
        xs[:, 0] = gates[at.T, 0]
        xs[:, 1] = gates[at.T[::-1], 1]
        state, states, kept = np.zeros((2, n, h), np.float32), np.empty((size, 2, n, h), np.float32), []
        for t in range(size):
            a = np.matmul(state, p["state"])
            rz = _sigmoid(xs[t, :, :, : 2 * h] + a[:, :, : 2 * h])
            r, z = rz[..., :h], rz[..., h:]
            inner = a[:, :, 2 * h :] + p["inner"]
            new = np.tanh(xs[t, :, :, 2 * h :] + r * inner)
            if keep:
                kept.append((state, r, z, inner, new))
            state = new + z * (state - new)
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # words x windows x 2h
        weight = both @ p["attend"]
        weight[(at.T == len(gates) - 1)] = -40
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        logit = pooled @ p["out"] + p["offset"]
        return (logit, (at, kept, both, weight, pooled)) if keep else logit

    def backward(self, w: Words, x: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        at, steps, both, weight, pooled = kept
        size, n = len(steps), len(d_logit)
        g = {"out": pooled.T @ d_logit, "offset": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_both = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tn,tnh->h", d_score, both)
        d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)
        g["state"], g["inner"] = np.zeros_like(p["state"]), np.zeros_like(p["inner"])
        d_gates = np.zeros((len(x), 2, 3 * h), np.float32)
        d = np.zeros((2, n, h), np.float32)
        for t in reversed(range(size)):
            before, r, z, inner, new = steps[t]
            d = d + d_states[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_r = d_new * inner * r * (1 - r)
            d_z = d * (before - new) * z * (1 - z)
            d_a = np.concatenate([d_r, d_z, d_new * r], axis=2)
            g["state"] += np.matmul(before.transpose(0, 2, 1), d_a)
            g["inner"] += (d_new * r).sum(1, keepdims=True)
            d_x = np.concatenate([d_r, d_z, d_new], axis=2)
            np.add.at(d_gates[:, 0], at[:, t], d_x[0])
            np.add.at(d_gates[:, 1], at[:, size - 1 - t], d_x[1])
            d = d * z + np.matmul(d_a, p["state"].transpose(0, 2, 1))
        d_gates = d_gates[:-1].reshape(-1, 6 * h)
        g["input"], g["bias"] = x[:-1].T @ d_gates, d_gates.sum(0)
        d_words = d_gates @ p["input"].T
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        hit = np.flatnonzero(np.abs(d_words).sum(1))
        np.add.at(g["words"], w.word[hit], d_words[hit, :EMBED])
        each = d_words[:, EMBED:] / np.maximum(w.grams, 1)[:, None]
        np.add.at(g["grams"], w.gram, np.repeat(each, w.grams, axis=0))
        return g

    def begin(self, w: Words, least: int) -> dict[str, np.ndarray]:
        """Sets vectors of buckets that under ``least`` texts hold to zero; returns which may learn."""
        text, learns = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first)), {}
        for name, bucket, of in (("words", w.word, text), ("grams", w.gram, np.repeat(text, w.grams))):
            pairs = np.unique(of * BUCKETS + bucket)
            learns[name] = (np.bincount(pairs % BUCKETS, minlength=BUCKETS) >= least).astype(np.float32)[:, None]
            self.p[name] *= learns[name]
        return learns

    def logits(self, gates: np.ndarray, at: np.ndarray, batch: int = 1024) -> np.ndarray:
        return np.concatenate([self.forward(gates, at[i : i + batch]) for i in range(0, len(at), batch)])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as got:
            self.p = {k: got[k] for k in got.files}
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text: that of its highest window."""
        out = np.full(len(texts), -np.inf)
        w = Words(texts)
        gates = self.gates(self.inputs(w))
        at, text = w.windows()
        np.maximum.at(out, text, self.logits(gates, at))
        out[np.diff(w.first) == 0] = -30
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _highest(logit: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` highest windows of each text, by text."""
    order = np.lexsort((-logit, text))
    t = text[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    nth = np.arange(len(t)) - np.repeat(first, np.diff(np.r_[first, len(t)]))
    return order[nth < most]


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Network | None:
    """A network fitted to labelled texts; None unless both kinds are there."""
    label = np.array(toxic, bool)
    if label.all() or not label.any():
        return None
    net, order = Network(seed), np.random.default_rng(seed)
    learns = net.begin(Words(texts), min(LEAST_TEXTS, max(2, len(texts) // 100)))
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = -(-len(texts) // BATCH_DOCS)
    epochs = min(40, max(EPOCHS, -(-100 // steps)))  # few rows: more rounds
    step = 0
    for epoch in range(epochs):
        shuffled = order.permutation(len(texts))
        for i in range(0, len(texts), BATCH_DOCS):
            chosen = shuffled[i : i + BATCH_DOCS]
            w = Words([texts[j] for j in chosen])
            at, text = w.windows()
            x = net.inputs(w)
            gates = net.gates(x)
            best = _highest(net.logits(gates, at), text, AT_FIRST if 2 * epoch < epochs else 1)
            text = text[best]
            logit, kept = net.forward(gates, at[best], keep=True)
            y = label[chosen].astype(np.float32)[text]
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            likely = np.exp(logit - np.maximum.reduceat(logit, first)[text])
            # a toxic text's windows count by how likely they are the toxic ones, a clean one's alike
            weight = np.where(y > 0, TOXIC_WEIGHT * likely / np.bincount(text, likely)[text], 1 / np.bincount(text)[text])
            d = ((_sigmoid(logit) - y) * weight / len(chosen)).astype(np.float32)
            step += 1
            left = 1 - step / (steps * epochs + 1)
            for k, g in net.backward(w, x, kept, d).items():
                if k in learns:
                    g *= learns[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= (left * (TABLE_RATE if k in TABLES else RATE) / (1 - 0.9**step)) * mean[k] / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return net


# ---------------------------------------------------------------------- tables


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(picked), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN rows
    staging.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)})
        net = train([r[1] for r in rows], [r[2] for r in rows]) if rows else None
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([net.to_bytes()], pa.binary())], names=["net"])

    # of rows repeated under one id one counts, so the sample is bounded whatever the table holds
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = one.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "net binary").collect()  # a model of fixed size
    return Network.from_bytes(bytes(got[0]["net"])) if got else None


def score_documents(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``."""
    spark = docs.sparkSession
    staging.ship(spark)
    keep = keep or ["doc_id"]
    model = spark.sparkContext.broadcast(net)
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for part in _portions(texts):
                score = np.zeros(len(part)) if model.value is None else model.value.scores([texts[i] for i in part])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(part.start, len(part)) for i in range(len(keep))), pa.array(score, pa.float64())], names=[*keep, "score"])

    chosen = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(run, f"{types}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score under the threshold, unchanged."""
    return score_documents(docs, fit(docs, labels), docs.columns).filter(F.col("score") < THRESHOLD).drop("score")


def _portions(texts: list[str], chars: int = 1 << 20) -> Iterator[range]:
    """Ranges of texts of about ``chars`` together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
