"""Operator 11: periodic runs of words, by online dyadic square catching.

Every completed block of L = 2^k words, counted from its text's start, becomes a catcher for the periods 2L - 1 to
4L - 2: whatever stretch has such a period for longer than it holds one of these blocks whole.  Each appended word
completes one suffix of L words per level, and exactly two catchers of the level have it at a distance in their range:
two comparisons a word and level, O(n log n) in all, made as arrays over a stretch of appended words.  Equal ones are
squares' halves; squares of one period on consecutive blocks are chained, and a chain that no further block extends is
grown to its maximal run.  Blocks are compared by 64-bit hashes, and the bytes of a run's words confirm it.

Null and blank texts have no words and no runs.  Rows are judged one by one, so repeated rows, equal and null ids give a
row each; texts are read whole, however long (a text is one task's row).  Ties between periods of one stretch go to the
smallest.  An empty table gives an empty one.  Further columns are carried only if asked for, under ``input_<name>``
where they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, kept_names, mix64, slices, span_hashes, utf8

#: Words appended at a time.
STRETCH = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9FB21C651E98DF25)
RESULTS = ("n_words", "runs", "collapsed")


def blank_words(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every stretch without blanks, and for each row the number of its first one (n + 1)."""
    inside = np.zeros(len(blob) + 2, bool)  # a byte before and after
    inside[1:-1] = ~_SPACE[blob]
    cut = np.zeros(len(blob) + 1, bool)  # a row's first byte starts a word even if the row before ends with one
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class SquareCatcher:
    """Catches squares in several texts, whose words are appended in order.

    words: a hash per word; first: number of each text's first word (n + 1); same(i, j, n) says for each of n words
    from i and from j on whether they are truly equal.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, same, min_length: int = 6, min_exponent: int = 4):
        self.words, self.same, self.min_length, self.min_exponent = words, same, min_length, min_exponent
        count = np.diff(first)
        self.text = np.repeat(np.arange(len(count)), count)
        self.lo, self.hi = first[:-1], first[1:]
        self.size = count
        self.done = 0
        none = np.zeros(0, np.int64)
        #: per level: chains (period, first and last block) that further words may extend
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: per level: the hash of the suffix that starts at a word
        self.suffix = [words.copy()]
        while self.min_exponent * (2 * (1 << len(self.open)) - 1) <= max(count, default=0):
            self.open.append((none, none, none))
            if len(self.suffix) < len(self.open):
                self.suffix.append(np.zeros(len(words), np.uint64))
        #: runs by (start, end), with their smallest period; of those known so far starts, furthest ends up to each, and periods of these
        self.runs: dict[tuple[int, int], int] = {}
        self._known = (none, none, none)

    def append(self, n: int) -> None:
        """The next n words arrive."""
        a, b = self.done, min(self.done + n, len(self.words))
        self.done = b
        for k in range(len(self.open)):
            self._catch(k, 1 << k, a, b)

    def _catch(self, k: int, size: int, a: int, b: int) -> None:
        s0, s1 = max(0, a - size + 1), b - size + 1  # suffixes that the new words complete
        if s1 <= s0:
            return
        if k:
            half = size >> 1
            self.suffix[k][s0:s1] = mix64(self.suffix[k - 1][s0:s1] * _MIX + self.suffix[k - 1][s0 + half : s1 + half])
        s = np.arange(s0, s1)
        text = self.text[s0:s1]
        lo = self.lo[text]
        at = s - lo - (2 * size - 1)
        use = (at >= 0) & (s + size <= self.hi[text]) & (self.size[text] >= self.min_exponent * (2 * size - 1))
        s, lo, at = s[use], lo[use], at[use]
        near = lo + (at >> k << k)
        mine = self.suffix[k][s]
        found = [np.flatnonzero(self.suffix[k][near] == mine)]
        further = near - size
        inside = np.flatnonzero(further >= lo)
        found.append(inside[self.suffix[k][further[inside]] == mine[inside]])
        block = np.concatenate([near[found[0]], further[found[1]]])
        period = np.concatenate([s[found[0]], s[found[1]]]) - block
        self._chain(k, size, period, block, b)

    def _chain(self, k: int, size: int, period: np.ndarray, block: np.ndarray, end: int) -> None:
        """Joins new squares to the chains of their period, and closes the chains that are over."""
        old = self.open[k]
        q, x, y = np.concatenate([old[0], period]), np.concatenate([old[1], block]), np.concatenate([old[2], block])
        if not len(q):
            return
        order = np.lexsort((x, q))
        q, x, y = q[order], x[order], y[order]
        heads = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (x[1:] != y[:-1] + size) | (self.text[x[1:]] != self.text[x[:-1]])]))
        tails = np.concatenate([heads[1:], [len(q)]]) - 1
        q, x, y = q[heads], x[heads], y[tails]
        more = y + 2 * size + q
        going = np.minimum(more, self.hi[self.text[x]]) > end
        self.open[k] = (q[going], x[going], y[going])
        need = (np.maximum((self.min_exponent - 1) * q, self.min_length - q) - size + 1) // size
        over = ~going & ((y - x) // size + 1 >= need)
        q, x, y = q[over], x[over], y[over]
        starts, furthest, least = self._known
        if len(starts) and len(q):  # a known run of smaller period around a chain is its run: that period divides the chain's
            before = np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)
            new = (starts[before] > x) | (furthest[before] < y + size + q) | (least[before] > q) | (y + size - x < q)
            q, x, y = q[new], x[new], y[new]
        found = len(self.runs)
        for one in zip(q.tolist(), x.tolist(), y.tolist()):
            self._grow(size, *one)
        if len(self.runs) > found:
            spans = np.array(sorted((*k, v) for k, v in self.runs.items()), np.int64)
            furthest = np.maximum.accumulate(spans[:, 1])
            at = np.maximum.accumulate(np.where(spans[:, 1] == furthest, np.arange(len(spans)), 0))
            self._known = (spans[:, 0], furthest, spans[at, 2])

    def _grow(self, size: int, q: int, first: int, last: int) -> None:
        """The maximal runs of period q around the chain of blocks."""
        lo, hi = int(self.lo[self.text[first]]), int(self.hi[self.text[first]])
        a, b = max(lo, first - size), min(hi - q, last + 2 * size)
        equal = self.words[a:b] == self.words[a + q : b + q]
        bad = np.flatnonzero(~equal)
        heads, tails = np.concatenate([[0], bad + 1]), np.concatenate([bad, [b - a]])
        for i, j in zip((heads + a).tolist(), (tails + a).tolist()):
            if j - i < max((self.min_exponent - 1) * q, self.min_length - q):
                continue
            cut = np.concatenate([[-1], np.flatnonzero(~self.same(i, i + q, j - i)), [j - i]])
            for u, v in zip((cut[:-1] + 1 + i).tolist(), (cut[1:] + i).tolist()):
                if v - u >= max((self.min_exponent - 1) * q, self.min_length - q):
                    span = (u, v + q)
                    self.runs[span] = min(q, self.runs.get(span, q))


def _gather(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all bytes of the ranges, in order."""
    size = ends - starts
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - size), size)


def text_runs(blob: np.ndarray, offsets: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Bounds of all words, each row's first word, and the runs (start, length, period) by row and start, over word numbers of the whole batch."""
    starts, ends, first = blank_words(blob, offsets)

    def same(i: int, j: int, n: int) -> np.ndarray:
        a, b = slice(i, i + n), slice(j, j + n)
        size = ends[a] - starts[a]
        out = size == ends[b] - starts[b]
        if out.all() and n:
            differ = blob[_gather(starts[a], ends[a])] != blob[_gather(starts[b], ends[b])]
            out = np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0
        elif n:  # words of other lengths under one hash: word by word
            out = np.array([np.array_equal(blob[starts[i + x] : ends[i + x]], blob[starts[j + x] : ends[j + x]]) for x in range(n)])
        return out

    catcher = SquareCatcher(span_hashes(blob, starts, ends), first, same, min_length, min_exponent)
    while catcher.done < len(starts):
        catcher.append(STRETCH)
    return starts, ends, first, sorted((a, b - a, q) for (a, b), q in catcher.runs.items())


def collapsed_texts(blob: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: list[tuple[int, int, int]]) -> pa.Array:
    """Each row's words without those that a run holds after its first period, one space between them."""
    drop = np.zeros(len(starts) + 1, np.int32)
    for a, n, q in runs:
        drop[a + q] += 1
        drop[a + n] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    bounds = np.searchsorted(kept, first)
    last = np.zeros(len(kept), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    # a word takes the blank after it along, but for a row's last
    s, e = starts[kept], ends[kept] + ~last
    mark = np.zeros(len(blob) + 2, np.int8)
    mark[s] += 1
    mark[e] -= 1
    take = np.cumsum(mark[: len(blob)], dtype=np.int8) > 0
    out = blob[take]
    out[_SPACE[out]] = 32
    at = np.concatenate([[0], np.cumsum(e - s)])[bounds]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: its id, n_words, runs (start, length and smallest period in words, by start and period), and the collapsed text.

    A run is a stretch of min_length words or more, and min_exponent periods or more, that no neighbouring word extends
    keeping the period (min_exponent is 2 or more, as runs are chained squares).  A map without shuffle.
    """
    if min_exponent < 2:
        raise ValueError("squares are of exponent 2 at least")
    names = kept_names([id_col, *keep], RESULTS)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                blob, offsets = utf8(batch.column(batch.num_columns - 1))
                starts, ends, first, runs = text_runs(blob, offsets, min_length, min_exponent)
                row = np.searchsorted(first, [a for a, _, _ in runs], side="right") - 1
                mine: list[list] = [[] for _ in range(batch.num_rows)]
                for r, (a, n, q) in zip(row.tolist(), runs):
                    mine[r].append((a - int(first[r]), q, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1], pa.array(np.diff(first), pa.int64()),
                        pa.array([[{"start": a, "length": n, "period": q} for a, q, n in sorted(m)] for m in mine], run_type),
                        collapsed_texts(blob, offsets, starts, ends, first, runs),
                    ],
                    names=[*names.values(), *RESULTS],
                )

    bounded_batches(docs.sparkSession)
    kind = ", ".join(f"`{n}` {types[c]}" for c, n in names.items())
    columns = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    return docs.select(*columns, F.col(f"`{text_col}`").alias("_")).mapInArrow(run, f"{kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
