"""Rank-synchronous byte-pair merging over ragged numpy arrays.

A batch of pre-tokens is one flat array of symbol ids with the owner of each symbol.  In every round each
sequence merges the leftmost occurrence of its lowest-ranked adjacent pair, all sequences at once; a
sequence without a mergeable pair leaves the batch.  One merge a round and sequence is what makes the
result equal to the sequential libraries, also where a merge creates a pair of lower rank.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

NEVER = np.int32(2**31 - 1)
#: Longer sequences go through a heap: rounds over them would cost the square of their length.
LONG = 256


class PairTable:
    """(left, right) -> (rank, merged) as an open-addressing table that is probed with whole arrays."""

    def __init__(self, left, right, merged, rank):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NEVER)
        self.merged = np.zeros(size, np.int32)
        rest, slot = np.arange(len(key)), self._slot(key)
        merged, rank = np.asarray(merged, np.int32), np.asarray(rank, np.int32)
        while len(rest):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, one = np.unique(np.where(free, slot, size + np.arange(len(slot))), return_index=True)
            put = one[free[one]]
            i = rest[put]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[i], rank[i], merged[i]
            stay = np.ones(len(rest), bool)
            stay[put] = False
            rest, slot = rest[stay], (slot[stay] + 1) & (size - 1)

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        there = self.keys[slot]
        other = np.flatnonzero((there != key) & (there != np.uint64(2**64 - 1)))
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[other]]
            other = other[(there != key[other]) & (there != np.uint64(2**64 - 1))]
        return np.where(self.keys[slot] == key, self.rank[slot], NEVER), self.merged[slot]


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The surviving symbols of each sequence, in order, and their number by sequence."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    done_s, done_o = [], []
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        for i in long:
            got = merge_long(table, symbols[bounds[i] : bounds[i + 1]])
            done_s.append(got)
            done_o.append(np.full(len(got), i))
        keep = ~np.isin(owner, long)
        symbols, owner = symbols[keep], owner[keep]
    sym, own = symbols.astype(np.int32, copy=True), owner
    rank, into = np.full(len(sym), NEVER), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        at = np.flatnonzero(own[1:] == own[:-1])
        rank[at], into[at] = table(sym[at], sym[at + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.concatenate([starts, [len(sym)]]))
        best = np.minimum.reduceat(rank, starts)
        over = best == NEVER
        if over.any():
            out = np.repeat(over, size)
            done_s.append(sym[out])
            done_o.append(own[out])
            stay = ~out
            sym, own, rank, into = sym[stay], own[stay], rank[stay], into[stay]
            best, size = best[~over], size[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        first = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
        sym[first] = into[first]
        stay = np.ones(len(sym), bool)
        stay[first + 1] = False
        sym, own, rank, into = sym[stay], own[stay], rank[stay], into[stay]
        first = first - np.arange(len(first))
        rank[first] = NEVER
        left = first[first > 0] - 1
        at = np.concatenate([first[first + 1 < len(sym)], left])
        at = at[own[at] == own[at + 1]]
        rank[at], into[at] = table(sym[at], sym[at + 1])
    if not done_s:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    sym, own = np.concatenate(done_s), np.concatenate(done_o)
    return sym[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)


def merge_long(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """The same merges for one long sequence, with a heap of (rank, place)."""
    sym = symbols.tolist()
    n = len(sym)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    rank, into = table(symbols[:-1], symbols[1:])
    heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, into)) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = m, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        pairs = [(before[i], i)] * (before[i] >= 0) + [(i, after[i])] * (after[i] >= 0)
        if pairs:
            r, q = table(np.array([sym[x] for x, _ in pairs]), np.array([sym[y] for _, y in pairs]))
            for (x, y), rr, qq in zip(pairs, r.tolist(), q.tolist()):
                if rr != NEVER:
                    heapq.heappush(heap, (rr, x, sym[x], sym[y], qq))
    return np.array([x for x in sym if x >= 0], np.int32)


class PieceModel:
    """A sentencepiece BPE model with byte fallback: pairs ranked by the score of the piece they form."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = {p: i for i, p in enumerate(pieces) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        if any("▁" in p.lstrip("▁") or "\n" in p for p in plain):
            raise ValueError("pieces of this model cross the places where texts are cut")
        scores = {i: lib.get_score(i) for i in plain.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(plain[p[:k]], plain[p[k:]], i, order[scores[i]]) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        self.table = PairTable(*zip(*pairs))
        self.size = len(pieces)
        #: Symbol of each code point; one that the model lacks stands for its UTF-8 bytes: size + their number.
        code = np.arange(0x110000)
        self.symbol = (self.size + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def counts(self, pretokens: list[str]) -> list[int]:
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        code = np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)
        sym, left = merge(self.table, self.symbol[code], sizes)
        weight = np.maximum(sym - self.size, 1)
        total = np.zeros(len(pretokens), np.int64)
        np.add.at(total, np.repeat(np.arange(len(pretokens)), left), weight)
        return total.tolist()


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)
