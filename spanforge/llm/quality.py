"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words, all of them.  A passage's features (shares of byte classes,
word shapes and repetition, hashed byte pairs) go through an encoder layer; a gated attention layer, learned from
document labels alone, weighs the passages; the weighted representation gives the logit.  Training runs on the
driver over a bounded sample of labelled documents (``LEARN`` at most); scoring runs over all texts in Arrow
batches and needs memory for one chunk of texts only.

Defined results: a null or empty text is one passage without features and gets the score of that; repeated rows
get equal scores; documents without label are scored like all; if no label is usable every score is 0.5; an empty
table gives an empty result; other columns of the documents are carried through, ``score`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_WHITE, batch_chunks, gather_spans, lean, read, words
from .labelled import remainder, sample, texts

PASSAGE = 64
LEARN = 6000
HASHED = 48

_CLASSES = ["\n", " \t\r\v\f", "!", "?", ".", ",", ";:", "\"'()", "$", "%", "&", "*", "#", "|", "-_/\\", "@<>[]{}=+~^`"]
_CLASS = np.zeros(256, np.int64)
for _n, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _n
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = len(_CLASSES) + [48, 65, 97, 128].index(_a)
N_CLASSES = len(_CLASSES) + 4
N_FEATURES = N_CLASSES + 9 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, text of each); a text without words is one empty passage."""
    n = len(offsets) - 1
    start, end, text, hashes = words(data, offsets, WORD_WHITE)
    counts = np.bincount(text, minlength=n)
    per = np.maximum(1, -(-counts // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per)])
    first_word = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(n), per)
    total = int(base[-1])
    x = np.zeros((total, N_FEATURES), np.float32)
    if not len(start):
        return x, owner
    nth = np.arange(len(start)) - first_word[text]
    passage = base[text] + nth // PASSAGE
    # Bytes belong to the passage of the last word that has begun, in a text before its first word to the first;
    # those of texts without words to none (number ``total``).
    begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    lead = start[begins].copy()
    lead[nth[begins] == 0] = offsets[text[begins[nth[begins] == 0]]]
    text_end = offsets[text[begins] + 1]
    stop = np.minimum(np.concatenate([lead[1:], [len(data)]]), text_end)
    of_byte = np.full(len(data), total)
    of_byte[gather_spans(lead, stop - lead)] = np.repeat(passage[begins], stop - lead)
    size = np.bincount(of_byte, minlength=total + 1)[:total].astype(np.float32)
    one = np.maximum(size, 1)[:, None]
    x[:, :N_CLASSES] = np.bincount(of_byte * N_CLASSES + _CLASS[data], minlength=(total + 1) * N_CLASSES)[: total * N_CLASSES].reshape(total, N_CLASSES) / one
    length = (end - start).astype(np.float32)
    n_words = np.bincount(passage, minlength=total).astype(np.float32)
    some = np.maximum(n_words, 1)
    mean = np.bincount(passage, length, total) / some
    order = np.lexsort((hashes, passage))
    p, h = passage[order], hashes[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    heads = np.flatnonzero(fresh)
    most = np.zeros(total)
    np.maximum.at(most, p[heads], np.diff(np.concatenate([heads, [len(p)]])))
    at = N_CLASSES
    x[:, at] = n_words / PASSAGE
    x[:, at + 1] = mean / 8
    x[:, at + 2] = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / some - mean**2, 0)) / 8
    x[:, at + 3] = np.bincount(p[fresh], minlength=total) / some
    x[:, at + 4] = np.bincount(passage, again, total) / some
    x[:, at + 5] = most / some
    lower = (data[end - 1] >= 97) & (data[end - 1] < 123) | (data[end - 1] >= 128)
    x[:, at + 6] = np.bincount(passage, lower, total) / some
    x[:, at + 7] = np.bincount(passage, (data[start] >= 65) & (data[start] < 91), total) / some
    x[:, at + 8] = np.log1p(size) / 8
    pair = (_CLASS[data[:-1]] * 31 + _CLASS[data[1:]] * 7) % HASHED
    inside = np.ones(len(pair), bool)
    inside[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
    x[:, at + 9 :] = np.bincount((of_byte[:-1] * HASHED + pair)[inside], minlength=(total + 1) * HASHED)[: total * HASHED].reshape(total, HASHED) / one
    x[n_words == 0] = 0
    return x, owner


class AttentionMil:
    """Encoder, gated attention and logit; gradients by hand, Adam."""

    def __init__(self, n_in: int, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "W": r.normal(0, n_in**-0.5, (n_in, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)),
            "U": r.normal(0, hidden**-0.5, (hidden, gate)), "a": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(n_in, np.float32), np.ones(n_in, np.float32)

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        w = self.w
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, e)
        e = np.exp(e - top[owner])
        alpha = e / np.bincount(owner, e, n)[owner]
        starts = np.searchsorted(owner, np.arange(n))
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return h, t, s, alpha, z, z @ w["c"] + w["d"][0]

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, owner, n)[-1], -40, 40)))

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some documents, by weight."""
        w, n = self.w, len(y)
        h, t, s, alpha, z, logit = self.forward(x, owner, n)
        g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
        xs = (x - self.mean) / self.scale
        gz = g[:, None] * w["c"]
        ga = (gz[owner] * h).sum(1)
        ge = alpha * (ga - np.bincount(owner, alpha * ga, n)[owner])
        gt, gs = ge[:, None] * w["a"] * s * (1 - t * t), ge[:, None] * w["a"] * t * s * (1 - s)
        gh = (alpha[:, None] * gz[owner] + gt @ w["V"].T + gs @ w["U"].T) * (1 - h * h)
        return {"W": xs.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "a": ((t * s) * ge[:, None]).sum(0), "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 4e-3, decay: float = 1e-5, seed: int = 5):
        self.mean = x.mean(0)
        self.scale = x.std(0) + 1e-3
        r, w = np.random.default_rng(seed), self.w
        m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
        bounds = np.searchsorted(owner, np.arange(len(y) + 1))
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for a in range(0, len(y), batch):
                pick = order[a : a + batch]
                size = bounds[pick + 1] - bounds[pick]
                rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
                own, xb = np.repeat(np.arange(len(pick)), size), x[rows]
                grad = self.gradients(xb, own, y[pick])
                step += 1
                lr = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
                for k, p in w.items():
                    d = grad[k] + decay * p
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, column: str, chosen, limit: int = LEARN) -> AttentionMil | None:
    """Fit on at most ``limit`` labelled documents; None if there is no label of each kind."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                x, owner = passages(data, offsets)
                part = batch.slice(a, b - a)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    found = texts(docs, sample(labels, column, chosen, limit)).select("doc_id", "y", "text")
    table = found.mapInArrow(lean(run), "doc_id long, y int, x binary").toArrow()
    if not table.num_rows:
        return None
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    ids, y = np.asarray(table.column("doc_id")), np.asarray(table.column("y"))
    order = np.argsort(ids, kind="stable")
    x, ids, y = x[order], ids[order], y[order]
    _, first, owner = np.unique(ids, return_index=True, return_inverse=True)
    y = y[first]
    if y.min() == y.max():
        return None
    return AttentionMil(N_FEATURES).fit(x, owner, y.astype(float))


def score(docs: DataFrame, model: AttentionMil | None, text: str = "text") -> DataFrame:
    """Adds ``score``: the probability of label 1."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch, text):
                out = shared.value.score(*passages(data, offsets), b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels"), "quality", remainder(3) != 1)
    scored = score(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
