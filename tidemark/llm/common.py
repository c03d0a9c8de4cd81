"""Helpers that several corpus operators share: Arrow columns as numpy bytes, hashing, shared folders."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the text contracts: digits, a-z and every byte above 0x7F, after lower-casing A-Z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_memos: list[dict] = []


def memo() -> dict:
    """A worker's memo for one operator; it is emptied when the worker goes on to an operator that releases memory."""
    _memos.append({})
    return _memos[-1]


def release_memory() -> None:
    """Gives freed buffers back to the system: workers live on, and two of them share an executor's memory."""
    for kept in _memos:
        kept.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not a GNU system
    _trim = None


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 2 << 20):
    """Consecutive parts of a batch with about max_bytes of text each, so that numpy temporaries stay small.

    One longer text is a part of its own.
    """
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def words(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start and end byte of every word; for each row the number of its first word (n + 1)."""
    low = _LOWER[blob]
    inside = _IS_WORD[low]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(blob)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps by design."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64))
#: Bytes whose span hashes are made at a time.
_STRETCH = 1 << 20
_powers: dict[str, np.ndarray] = {}


def span_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by differences of prefix sums of a polynomial in mixed bytes.

    starts must not fall.  Ranges are taken a stretch of bytes at a time, which bounds the temporaries.
    """
    out = np.zeros(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(starts // _STRETCH)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)]):
        if a == b:
            continue
        s, e = starts[a:b], ends[a:b]
        lo, hi = int(s[0]), max(int(e.max()), int(s[0]))
        if len(_powers.get("p", ())) < hi - lo + 1:
            for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
                row = np.full(max(hi - lo + 1, _STRETCH + (1 << 16)), base, np.uint64)
                row[0] = 1
                _powers[name] = np.multiply.accumulate(row)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_SPREAD[blob[lo:hi]] * _powers["p"][: hi - lo], out=total[1:])
        s, e = s - lo, e - lo
        out[a:b] = mix64((total[e] - total[s]) * _powers["q"][s] + (e - s).astype(np.uint64))
    return out


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and the n + 1 bounds per row; a shorter row gives one run of all its words."""
    n = len(word_hash)
    count = np.diff(first)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: n - j] = mix64(h[: n - j] * np.uint64(0x100000001B3) + word_hash[j:]) if j else mix64(word_hash)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(n) - first[row]
    keep = place <= np.maximum(count[row] - k, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    for i in short:  # a few words each
        x = mix64(word_hash[first[i] : first[i] + 1])
        for j in range(first[i] + 1, first[i + 1]):
            x = mix64(x * np.uint64(0x100000001B3) + word_hash[j : j + 1])
        h[first[i]] = x[0]
    return h[keep], np.concatenate([[0], np.cumsum(np.maximum(count - k + 1, np.minimum(count, 1)))])


def kept_names(keep: Iterable[str], results: Iterable[str]) -> dict[str, str]:
    """The names that carried columns have beside result columns: their own, or ``input_<name>`` where they clash."""
    keep, taken, out = list(dict.fromkeys(keep)), {r.lower() for r in results}, {}
    own = {c.lower() for c in keep}
    for c in keep:
        name = c
        while name.lower() in taken or name != c and name.lower() in own:
            name = f"input_{name}"
        taken.add(name.lower())
        out[c] = name
    return out


def named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of names, under their new names."""
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))


#: Rows of text that cross to Python at a time, at most.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size where it is larger: whole texts are long rows, and each batch is
    held several times over on its way to Python and back.  Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-llm-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors.

    scratch gets the path of a table that its maker will discard.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in scratch:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    scratch.clear()


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
