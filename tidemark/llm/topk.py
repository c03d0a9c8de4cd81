"""Operator 5: exact top-k by Hamming distance with incremental multi-index hashing.

A vector's code is one bit per dimension (set where the value is above 0).  Codes are dealt by hash into blocks
of bounded size, and so are the queries; each pair of a code block and a query block is one task.  It indexes its
codes by m segments of about log2(rows) bits, each with a table from segment values to codes.  If two codes differ
in at most ``m * r + a`` bits, then one of the segments up to a differs in at most r bits, or a later one in fewer.
So a task looks up all values at distance r in one segment after the other, then those at distance r + 1, verifies
the distances of what it finds, and ends each query as soon as its kth verified distance is covered.  No query is
compared with all codes.  Spark then merges what the blocks found, k + 1 rows of each.

Equal codes are one entry with their k + 1 smallest ids, so a hot vector is one row; equal query codes are
searched once.

Results: the k nearest rows with another id, ordered by distance and id.  Null vectors, ids and vectors of
another length than the first are left out; a null or NaN value counts as not above 0.  Fewer than k other
rows give fewer results, an empty table none.  Equal (id, code) rows count once; of an id with several codes the
nearest counts.  Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

WORD = 63  # bits of a code word, so that it stays positive
#: Codes and queries of one task at most (on average, as both are dealt by hash), and tasks at least.
BLOCK_CODES, BLOCK_QUERIES, TASKS = 1 << 20, 1 << 16, 12
#: Values that a task looks up at a time, and pairs that it verifies at a time.
PROBES, PAIRS = 1 << 20, 1 << 20


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, code array<long>) of all rows, and the number of bits."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    head = rows.agg(F.min_by(F.size("v"), "id").alias("n")).first()
    bits = head["n"] or 0
    if not bits:
        return rows.select("id", F.expr("array(0L)").alias("code")).filter("false"), 0
    word = [F.expr("+".join(f"if(coalesce(v[{i}] > 0 and not isnan(v[{i}]), false), {1 << (i - w)}L, 0L)" for i in range(w, min(w + WORD, bits)))) for w in range(0, bits, WORD)]
    return rows.filter(F.size("v") == bits).select("id", F.array(*word).alias("code")), bits


def segments(bits: int, rows: int) -> list[tuple[int, int]]:
    """Cuts codes into parts of about log2(rows) bits, 4 to 20."""
    m = max(1, round(bits / max(4, min(20, math.log2(max(rows, 2))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _values(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The bits lo to hi of codes given as words of WORD bits."""
    out = np.zeros(len(codes), np.int64)
    for b in range(lo, hi):
        out |= ((codes[:, b // WORD] >> (b % WORD)) & 1) << (b - lo)
    return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


@lru_cache(maxsize=64)
def _flips(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which ``radius`` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class MultiIndex:
    """Codes with a table per segment: the codes in the order of its values, and where each value begins."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.cuts = segments(bits, len(codes))
        self.values = [_values(codes, lo, hi) for lo, hi in self.cuts]
        self.order = [np.argsort(v, kind="stable").astype(np.int32) for v in self.values]
        self.begin = [np.searchsorted(v[o], np.arange((1 << (hi - lo)) + 1)).astype(np.int32) for v, o, (lo, hi) in zip(self.values, self.order, self.cuts)]
        #: Values looked up and pairs verified so far.
        self.looked_up = self.verified = 0

    def found(self, query: list[np.ndarray], segment: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, code, distance) of the pairs that differ in radius bits of this segment, in no fewer of any other one,
        and in more of those before it: all that an earlier step has not given."""
        lo, hi = self.cuts[segment]
        flips, begin, order = _flips(hi - lo, radius), self.begin[segment], self.order[segment]
        own = query[segment]
        step = max(1, PROBES // len(flips))
        for at in range(0, len(own), step):
            want = (own[at : at + step, None] ^ flips).ravel()
            self.looked_up += len(want)
            first, size = begin[want], begin[want + 1] - begin[want]
            some = np.flatnonzero(size)
            first, size, asker = first[some].astype(np.int64), size[some].astype(np.int64), at + some // len(flips)
            ends = np.cumsum(size)
            x = 0
            while x < len(some):
                y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, side="right")))
                n = size[x:y]
                code = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[x:y], n)]
                asks = np.repeat(asker[x:y], n)
                self.verified += len(asks)
                distance, new = np.zeros(len(asks), np.int64), np.ones(len(asks), bool)
                for j, values in enumerate(self.values):
                    part = np.bitwise_count(values[code] ^ query[j][asks])
                    distance += part
                    new &= part >= radius + (j < segment)
                yield asks[new], code[new].astype(np.int64), distance[new]
                x = y

    def nearest(self, queries: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id) of the first k ids of each query by distance and id; ids[bounds[c]:bounds[c + 1]] are those of code c."""
        none = np.zeros(0, np.int64)
        q, d, i = none, none, none
        done = [(none, none, none)]
        active = np.arange(len(queries))
        query = [_values(queries, lo, hi) for lo, hi in self.cuts]
        m = len(self.cuts)
        for radius in range(max((hi - lo for lo, hi in self.cuts), default=0) + 1):
            for segment, (lo, hi) in enumerate(self.cuts):
                if radius <= hi - lo:
                    for asks, code, distance in self.found([v[active] for v in query], segment, radius):
                        n = bounds[code + 1] - bounds[code]
                        member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - bounds[code], n)
                        q, d, i = _first(np.concatenate([q, np.repeat(active[asks], n)]), np.concatenate([d, np.repeat(distance, n)]), np.concatenate([i, ids[member]]), k)
                covered = np.bincount(q[d <= m * radius + segment], minlength=len(queries)) >= k
                over = covered[q]
                done.append((q[over], d[over], i[over]))
                q, d, i = q[~over], d[~over], i[~over]
                active = active[~covered[active]]
                if not len(active):
                    break
            if not len(active):
                break
        done.append((q, d, i))
        return tuple(np.concatenate(x) for x in zip(*done))


def _first(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's (distance, id) pairs the first k, the nearest of each id only."""
    order = np.lexsort((d, i, q))
    q, d, i = q[order], d[order], i[order]
    keep = np.ones(len(q), bool)
    keep[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, d, i = q[keep], d[keep], i[keep]
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
    return q[keep], d[keep], i[keep]


def _search(bits: int, k: int):
    """One block of codes and one of queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q = d = i = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            members = left.column("ids").combine_chunks()
            offsets = members.offsets.to_numpy().astype(np.int64)
            index = MultiIndex(_matrix(left.column("code")), bits)
            q, d, i = index.nearest(_matrix(right.column("query")), members.flatten().to_numpy(), offsets - offsets[0], k + 1)
        return pa.table({"query": right.column("query").take(pa.array(q)), "distance": pa.array(d, pa.int32()), "neighbor_id": pa.array(i, pa.int64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance of the k nearest other rows of each row where is_query holds."""
    codes, bits = binary_codes(vectors, id_col, vector_col)
    if not bits:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    codes = codes.select(F.col("id").cast("long").alias("id"), "code").distinct()
    # the smallest ids of a code, gathered in two steps so that a hot code is not collected
    numbered = codes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    ranked = numbered.withColumn("nth", F.row_number().over(Window.partitionBy("code", "part").orderBy("id"))).filter(f"nth <= {k + 1}")
    entries = staged(ranked.groupBy("code").agg(F.expr(f"slice(array_sort(collect_list(id)), 1, {k + 1})").alias("ids")), "codes")
    queries = staged(vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct().join(codes, "id"), "queries")
    wanted = staged(queries.select(F.col("code").alias("query")).distinct(), "wanted")
    blocks, chunks = max(TASKS, -(-entries.count() // block_codes)), max(1, -(-wanted.count() // block_queries))

    # each block of codes meets each block of queries once
    left = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("chunk", F.explode(F.expr(f"sequence(0, {chunks - 1})")))
    right = wanted.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_search(bits, k), "query array<long>, distance int, neighbor_id long")
    best = found.groupBy("query", "neighbor_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    best = best.withColumn("nth", F.row_number().over(order)).filter(f"nth <= {k + 1}").drop("nth")

    near = queries.withColumnRenamed("code", "query").join(best, "query").select(F.col("id").alias("query_id"), "distance", "neighbor_id").filter("neighbor_id <> query_id")
    near = near.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).filter(f"rank <= {k}").select("query_id", "rank", "neighbor_id", "distance")
