"""Operator 9: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is described by hashed pairs of neighbouring
character classes and by word statistics, and encoded by a tanh layer.  Gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the passages of a document, weighs the encodings, and a
logistic layer scores the weighted sum.  All weights are learned together from document labels alone.

Learning takes a bounded sample of the labelled rows (``max_per_class`` of each label, by a hash of the id,
which also bounds what reaches the driver); scoring reads every passage of every text.  Null and empty texts
are one passage without features, so they have a score too.  If nothing is labelled, all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, span_hashes, utf8, words

PASSAGE_WORDS = 64
#: Rows of each label that are learned from, about.
MAX_PER_CLASS = 1_500

# The classes of bytes whose neighbourhoods describe a passage.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "*#", "$%&@", "|", "'\"`()[]{}<>", ":;/\\-_=+~^"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_CLASS[:9] = _CLASS[127] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES * N_CLASSES + 5


def passages(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature row per passage, and the number of passages of each text (1 at least)."""
    _, starts, ends, first = words(blob, offsets)
    n_words = np.diff(first)
    count = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    to = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - (to - count)[row]
    begin = offsets[:-1][row].copy()
    later = nth > 0
    begin[later] = starts[first[row[later]] + nth[later] * PASSAGE_WORDS]
    size = np.diff(np.append(begin, offsets[-1]))
    of_byte = np.repeat(np.arange(len(row)), size)
    kind = _CLASS[blob]
    pair = np.empty(len(blob), np.int64)
    pair[:-1] = kind[:-1] * N_CLASSES + kind[1:]
    pair[-1:] = kind[-1:] * (N_CLASSES + 1)
    x = np.zeros((len(row), N_FEATURES), np.float32)
    squares = N_CLASSES * N_CLASSES
    x[:, :squares] = np.bincount(of_byte * squares + pair, minlength=len(row) * squares).reshape(len(row), squares)
    x[:, :squares] = np.sqrt(x[:, :squares] / np.maximum(size, 1)[:, None])
    if len(starts):
        word_row = np.repeat(np.arange(len(count)), n_words)
        of_word = (to - count)[word_row] + (np.arange(len(starts)) - first[word_row]) // PASSAGE_WORDS
        h = span_hashes(blob, starts, ends)
        n = np.maximum(np.bincount(of_word, minlength=len(row)), 1)
        order = np.lexsort((np.arange(len(h)), h, word_row))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (word_row[order[1:]] == word_row[order[:-1]])
        length = np.bincount(of_word, weights=ends - starts, minlength=len(row)) / n
        x[:, squares] = length / 10
        x[:, squares + 1] = np.sqrt(np.maximum(np.bincount(of_word, weights=(ends - starts) ** 2.0, minlength=len(row)) / n - length**2, 0)) / 10
        x[:, squares + 2] = np.bincount(of_word, weights=again, minlength=len(row)) / n
        x[:, squares + 3] = np.log1p(np.bincount(of_word, minlength=len(row))) / 5
        x[:, squares + 4] = np.log1p(n_words[row]) / 10
    return x, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Encoder, gated attention and output layer, with its own gradients."""

    def __init__(self, width: int = 24, gate: int = 12, seed: int = 9):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.p = {
            "W": r.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, width)), "b": np.zeros(width),
            "V": r.normal(0, 0.3, (width, gate)), "U": r.normal(0, 0.3, (width, gate)), "w": r.normal(0, 0.3, gate),
            "c": r.normal(0, 0.3, width), "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, starts = self.p, np.cumsum(count) - count
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["d"]), (x, h, t, g, a, z, starts)

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, count)[0].astype(np.float64)

    def gradient(self, y: np.ndarray, weight: np.ndarray, out: np.ndarray, kept: tuple, count: np.ndarray) -> dict:
        p, (x, h, t, g, a, z, starts) = self.p, kept
        s = ((out - y) * weight / len(y)).astype(np.float32)
        dz = np.repeat(s[:, None] * p["c"], count, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ s, "d": s.sum(keepdims=True)}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Attention:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        x = (x - self.mean) / self.scale
        positive = float(y.mean())
        weight = np.where(y > 0, 0.5 / max(positive, 1e-6), 0.5 / max(1 - positive, 1e-6)) if 0 < positive < 1 else np.ones(len(y))
        starts, r = np.cumsum(count) - count, np.random.default_rng(seed)
        m, v, step = {k: 0 * w for k, w in self.p.items()}, {k: 0 * w for k, w in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                n = count[pick]
                at = np.repeat(starts[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out, kept = self.forward(x[at], n)
                step += 1
                for k, g in self.gradient(y[pick], weight[pick], out, kept, n).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * 0.97**epoch * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, max_per_class: int = MAX_PER_CLASS) -> Attention | None:
    """labels: (id_col, label_col 0/1).  learn is a condition on id_col.  A document with several labels has the largest."""
    known = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, max_per_class / n))).otherwise(share)
    some = known.filter(F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                x, count = passages(*utf8(batch.column(1)))
                ends = np.cumsum(count)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(count, pa.int64()), pa.array([x[e - n : e].astype(np.float16).tobytes() for n, e in zip(count, ends)], pa.binary())], names=["y", "n", "x"])

    # the sample is bounded by max_per_class, so it is broadcast to the scan of the texts
    rows = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select(id_col, text_col, "_y").mapInArrow(describe, "y int, n long, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["y"], r["n"], bytes(r["x"][:64])))
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES) for r in rows]).astype(np.float32)
    return Attention().fit(x, np.array([r["n"] for r in rows]), np.array([r["y"] for r in rows], np.float32))


def score_quality(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                score = shared.value.score(*passages(*utf8(batch.column(1)))) if shared.value else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    return score_quality(docs, train(docs, labels, learn, id_col, text_col, label_col, max_per_class), id_col, text_col)
