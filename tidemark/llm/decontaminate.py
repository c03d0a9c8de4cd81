"""Operator 3: benchmark decontamination by Wu-Manber search over words.

The alphabet is the words of the benchmark (all others are one letter that no pattern has).  Blocks of two
words index a shift table: the distance from the block's place to the end of the nearest pattern that has it.
A block at a pattern's end (shift 0) opens a suffix bucket, whose patterns are compared word by word.  Cursors
of many text segments advance together as numpy arrays.

The patterns come in blocks of bounded size, one scan of the documents each, so that what is broadcast does
not grow with the benchmark.  Null or wordless texts hit nothing; null or wordless items and items without id
have no windows.  Equal windows of several items report all of them.  Whole texts are searched, however long;
repeated rows and rows of equal or null ids get a result each; an empty table gives an empty one, and an empty
benchmark hits nothing.  Columns that are not asked for are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD_PATTERN, bounded_batches, kept_names, named, slices, span_hashes, utf8, words

_WORD = re.compile(WORD_PATTERN)
_TABLE_BITS = 18
#: Bytes of benchmark text whose patterns are compiled, broadcast and searched in one scan.
BLOCK_BYTES = 8 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")
_SEGMENT = 256


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


class Patterns:
    """The compiled windows of some benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        windows: dict[tuple[str, ...], set[str]] = {}
        for key, text in items:
            w = item_words(text)
            if key is not None:
                for i in range(max(len(w) - window + 1, min(len(w), 1))):
                    windows.setdefault(tuple(w[i : i + window]), set()).add(str(key))
        vocabulary = sorted({x for w in windows for x in w})
        raw = [x.encode() for x in vocabulary]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        blob = np.frombuffer(b"".join(raw), np.uint8)
        hashes = span_hashes(blob, ends - np.array([len(r) for r in raw], np.int64), ends) if raw else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int64)
        number = {x: i + 1 for i, x in enumerate(vocabulary)}
        by_size: dict[int, list[tuple[str, ...]]] = {}
        for w in windows:
            by_size.setdefault(len(w), []).append(w)
        self.sizes = []
        for m, group in sorted(by_size.items()):
            grid = np.array([[number[x] for x in w] for w in group], np.int64)
            shift = np.full(1 << _TABLE_BITS, max(m - 1, 1), np.int16)
            for j in range(1, m):
                np.minimum.at(shift, block(grid[:, j - 1], grid[:, j]), m - 1 - j)
            suffix = block(grid[:, m - 2] if m > 1 else 0 * grid[:, 0], grid[:, m - 1])
            if m == 1:
                shift[suffix] = 0
            order = np.argsort(suffix, kind="stable")
            self.sizes.append((m, grid[order], shift, suffix[order], [sorted(windows[group[i]]) for i in order]))


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1_000_003 + b) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _TABLE_BITS)


def search(ids: np.ndarray, first: np.ndarray, patterns: Patterns) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(m, places of windows' last words, pattern numbers, items by pattern) for each window size m."""
    for m, grid, shift, suffix, items in patterns.sizes:
        begin, end = first[:-1] + m - 1, first[1:]
        parts = np.maximum(-((begin - end) // _SEGMENT), 0)
        row = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begin[row] + nth * _SEGMENT
        stop = np.minimum(at + _SEGMENT, end[row])
        found_at, found = [], []
        while len(at):
            code = block(ids[at - 1] if m > 1 else 0 * at, ids[at])
            step = shift[code].astype(np.int64)
            zero = step == 0
            if zero.any():
                place, key = at[zero], code[zero]
                lo, hi = np.searchsorted(suffix, key), np.searchsorted(suffix, key, side="right")
                n = hi - lo
                place = np.repeat(place, n)
                which = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                for j in (0, *range(m - 1, 0, -1)):  # the prefix first, as it differs most often
                    same = ids[place - m + 1 + j] == grid[which, j]
                    place, which = place[same], which[same]
                found_at.append(place)
                found.append(which)
            at = at + np.maximum(step, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        if found_at:
            yield m, np.concatenate(found_at), np.concatenate(found), items


def scan(column: pa.Array, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Words per row, first-word bounds, and by row the hit words (start, end) and the items found."""
    low, starts, ends, first = words(*utf8(column))
    h = span_hashes(low, starts, ends)
    at = np.minimum(np.searchsorted(patterns.hashes, h), max(len(patterns.hashes) - 1, 0))
    ids = np.where(patterns.hashes[at] == h, patterns.ids[at], 0) if len(patterns.hashes) else np.zeros(len(h), np.int64)
    spans: list[list] = [[] for _ in range(len(column))]
    items: list[set] = [set() for _ in range(len(column))]
    for m, place, which, names in search(ids, first, patterns):
        row = np.searchsorted(first, place, side="right") - 1
        for r, p, w in zip(row.tolist(), (place - first[row] - m + 1).tolist(), which.tolist()):
            spans[r].append((p, p + m))
            items[r].update(names[w])
    return np.diff(first), first, spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids of every document; keep: columns to carry along.

    A carried column that is named like a result comes as ``input_<name>``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = kept_names([id_col, text_col, *keep], [*RESULTS, "spans"])
    docs, columns, text = named(docs, names), list(names.values()), names[text_col]
    items = benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).filter("k is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    scanned = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    held = docs
    for b in range(blocks):
        some = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        patterns = spark.sparkContext.broadcast(Patterns([tuple(r) for r in some.collect()], window))
        held = held.mapInArrow(_scanner(columns.index(text), len(columns), patterns, b == 0), scanned)
    out = [n for c, n in names.items() if c != text_col or c in keep]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n, sha = [], [], []
            for s, i in zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()):
                to, total = 0, 0
                for a, b in sorted(map(tuple, np.frombuffer(s, np.int64).reshape(-1, 2).tolist())):
                    total += max(0, b - max(a, to))
                    to = max(to, b)
                hit.append(total)
                n.append(len(i))
                sha.append(hashlib.sha256(",".join(sorted(i)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([x > 0 for x in hit]), batch.column("item_ids")],
                names=[*out, *RESULTS],
            )

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.StringType()))
    schema = T.StructType([*(docs.schema[c] for c in out), *(T.StructField(n, t) for n, t in zip(RESULTS, kinds))])
    if blocks == 1:  # in one pass over the rows
        return docs.mapInArrow(lambda it: finish(_scanner(columns.index(text), len(columns), patterns, True)(it)), schema)
    return held.mapInArrow(finish, schema)


def _scanner(text: int, width: int, patterns, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                n, _, spans, items = scan(batch.column(text), patterns.value)
                raw = [np.array(s, np.int64).tobytes() for s in spans]
                if not first:
                    raw = [a + b for a, b in zip(batch.column("spans").to_pylist(), raw)]
                    items = [set(a) | b for a, b in zip(batch.column("item_ids").to_pylist(), items)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(width)), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                    names=[*(batch.schema.names[:width]), "n_words", "spans", "item_ids"],
                )

    return run
