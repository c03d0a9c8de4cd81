"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Characters of lower-cased texts, in runs of one to three, are hashed into buckets.  The counts by language
give a matrix of log-probabilities, which is broadcast (languages x buckets x 4 bytes); batches of texts are
scored in numpy as sparse sums of its entries.  Learning takes a bounded sample of the labelled rows
(``max_per_class`` of each language, by a hash of the id); prediction reads every whole text.

A null, empty or letterless text gets ``und`` and score 0, as do all if nothing is labelled.  Of languages with equal
scores the first by name wins.  Long texts are scored as a whole.  Ids may repeat or be null, repeated rows get a
result each, and an empty table an empty one.  Columns that are not asked for are not read; one of ``keep`` that is
named like a result comes as ``input_<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, kept_names, named, slices

BUCKET_BITS, ORDERS = 16, (1, 2, 3)
#: Rows of a language that are learned from, about; and languages at most.
MAX_PER_CLASS, MAX_CLASSES = 8_000, 500
UNKNOWN = "und"
RESULTS = ("lang_pred", "score")


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the bucket of each place, the first place of each text, and the places that run over a text's end."""
    lower = [t.lower() for t in texts]
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    code = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(size)
    h = np.zeros(len(code), np.uint32)
    for order in ORDERS:
        h = h * np.uint32(0x01000193)
        h[: len(code) - order + 1] ^= code[order - 1 :]
        over = np.unique(np.concatenate([ends - k for k in range(1, order)])) if order > 1 else np.zeros(0, np.int64)
        yield ((h * np.uint32(0x9E3779B1) + np.uint32(order)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), ends - size, over[(over >= 0) & (over < len(code))]


class Model:
    def __init__(self, labels: list[str], counts: np.ndarray, rows: np.ndarray, smoothing: float = 0.5):
        self.labels = labels
        counts = counts + smoothing
        self.log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log(rows / rows.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        known = np.array([t.isascii() and t.islower() or any(c.isalpha() for c in t) for t in texts], bool)
        if not self.labels or not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [t for t, k in zip(texts, known) if k]
        total = np.tile(self.prior[:, None], (1, len(some)))
        for bucket, starts, over in buckets(some):
            for i, row in enumerate(self.log_p):
                x = row[bucket]
                x[over] = 0
                total[i] += np.add.reduceat(x, starts, dtype=np.float64)
        best = total.argmax(axis=0)
        p = 1 / np.exp(np.maximum(total - total.max(axis=0), -700)).sum(axis=0)
        score = np.zeros(len(texts))
        score[known] = np.clip(p, 0, 1)
        found = iter(best.tolist())
        return [self.labels[next(found)] if k else UNKNOWN for k in known], score


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learns from labelled rows; Spark sums the counts by language and bucket."""
    labelled = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    labels = sorted(sizes)
    counts = np.zeros((len(labels), 1 << BUCKET_BITS))
    if labels:
        share = F.lit(0.0)
        for name, n in sizes.items():
            share = F.when(F.col("l") == name, F.lit(min(1.0, max_per_class / n))).otherwise(share)
        sample = labelled.filter(F.pmod(F.xxhash64("i", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, np.ndarray] = {}
            for whole in batches:
                for batch in slices(whole, 1):
                    texts, names = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), object)
                    for name in set(names.tolist()):
                        some = [t for t, x in zip(texts, names) if x == name]
                        for bucket, _, over in buckets(some):
                            got = own.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                            got += np.bincount(bucket, minlength=len(got))
                            got -= np.bincount(bucket[over], minlength=len(got))
            for name, got in own.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at])], names=["l", "bucket", "n"])

        # labels times buckets, however many rows are learned from
        found = sample.mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
        row = np.array([labels.index(x) for x in found.column("l").to_pylist()], np.int64)
        counts[row, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(labels, counts, np.array([sizes[x] for x in labels], float))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep (input_<name> where they clash with the results), and lang_pred and score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = kept_names([*keep, text_col], RESULTS)
    text, out = names[text_col], [names[c] for c in dict.fromkeys(keep)]
    rows = named(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(text), 1 << 20):
                found, score = shared.value.predict([t or "" for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*out, *RESULTS])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in out), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", keep: tuple[str, ...] | None = None, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Learns from the labelled rows where learn holds, and predicts all rows."""
    return identify(docs, train(docs.filter(learn), id_col, text_col, label_col, max_per_class), text_col, keep or (id_col,))
