"""Operator 4: best-fit packing of tokenised documents with certified bin counts.

1. Every text becomes ids plus an end id; only longer documents are cut, into pieces of the capacity.
2. Full pieces are sequences already.  The rest is dealt into groups of bounded size; each group is packed by
   best-fit decreasing, and dual-feasible functions give a lower bound of its bins.
3. Groups at their bound are certified.  Of the others, the documents of the least filled bins are exchanged:
   eight neighbouring groups pool them and pack them anew, and so on until one pool is left.  A pool keeps
   the old bins unless the new ones are fewer.

Null text counts as empty: a piece of one end id.  Rows with equal or null ids are packed as rows of their own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import memo, staged

#: Characters whose lower-casing, composition and classes are alike in the library and in Python.
_PLAIN = re.compile("[\t\n\r\x20-\x7e -±´-¸º»¿-įı-ɏ]*")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: White space in Python but not in the library.
_NO_SPACE = re.compile("[\x1c-\x1f]")
#: The settings of a tokenizer file that _PLAIN and _PRETOKEN stand for.
_NORMALIZERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Entries of a worker's memo of ids by white-space-free run; emptied when full, which changes no result.
MEMO = 600_000
#: Pieces that one task packs at a time, and neighbouring groups whose loose bins are pooled.
GROUP_ROWS, FAN = 20_000, 8
#: Pre-tokens that go to the library as one text.
ATOMS = 256


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, tuple[str, ...] | None, np.ndarray]:
    """The library's tokenizer, its added strings (None if its settings are others than those stated above), and
    which ids end a pre-token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    made = json.loads(found.to_str())
    added, suffix = made["added_tokens"], made["model"].get("end_of_word_suffix")
    known = made["normalizer"] == _NORMALIZERS and made["pre_tokenizer"].get("pretokenizers", [])[:1] == [_SPLIT] and made["pre_tokenizer"]["pretokenizers"][1]["type"] == "ByteLevel" and suffix
    known = known and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"].lower()] for a in added)
    ends = np.zeros(found.get_vocab_size(), bool)
    for token, i in found.get_vocab().items():
        ends[i] = bool(suffix) and token.endswith(suffix)
    return found, tuple(a["content"] for a in added) if known else None, ends


_memo: dict[str, dict[str, bytes]] = memo()


def _raw(lib: Tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


def _raw_atoms(lib: Tokenizer, ends: np.ndarray, atoms: list[str]) -> list[bytes]:
    """The ids of each pre-token: many of them are one text, whose ids are cut at ends of words."""
    some = _raw(lib, [" ".join(atoms[at : at + ATOMS]) for at in range(0, len(atoms), ATOMS)])
    raw = b"".join(some)
    cuts = (4 * np.flatnonzero(ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
    if len(cuts) != len(atoms) or cuts[-1:] != [len(raw)] * bool(atoms):
        raise ValueError("pre-tokens that don't end where words end")
    return [raw[a:b] for a, b in zip([0, *cuts], cuts)]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, as the library gives them.

    Tokens never cross white space and depend on their run alone, so distinct runs are encoded once, and the
    pre-tokens of plain runs, too.  Runs with unusual characters or added strings go to the library as they are.
    So do texts with white space of Python's that the library does not count as such, and all texts of a
    tokenizer with other settings.
    """
    lib, added, ends = _tokenizer(path)
    if added is None:
        return _raw(lib, texts)
    seen = _memo.setdefault(path, {})
    runs = []
    for t in texts:
        low = t.lower() if _PLAIN.fullmatch(t) else None
        if low is not None and not any(a in low for a in added):
            runs.append(low.split())
        else:
            runs.append(None if _NO_SPACE.search(t) else t.split())
    new = set().union(*(r for r in runs if r)).difference(seen)
    if len(seen) + len(new) > MEMO:
        seen.clear()
        new = set().union(*(r for r in runs if r))
    odd = [w for w in new if not _PLAIN.fullmatch(w) or any(a in w.lower() for a in added)]
    parts = {w: _PRETOKEN.findall(w.lower()) for w in new.difference(odd)}
    atoms = list({a for p in parts.values() for a in p}.difference(seen))
    seen.update(zip(atoms, _raw_atoms(lib, ends, atoms)))
    get = seen.__getitem__
    seen.update([(w, b"".join(map(get, p))) for w, p in parts.items() if len(p) > 1 or p[0] != w])
    seen.update(zip(odd, _raw(lib, odd)))
    return [b"".join(map(get, r)) if r is not None else _raw(lib, [t])[0] for t, r in zip(texts, runs)]


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and the ids themselves, on demand) of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_ids = [b + end for b in encode([t or "" for t in part.column(1).to_pylist()], path)]
                row, cut = [], []
                for i, b in enumerate(all_ids):
                    for k in range(0, len(b), 4 * capacity):
                        row.append(i)
                        cut.append((k // (4 * capacity), k // 4, b[k : k + 4 * capacity]))
                out = [part.column(0).take(pa.array(row)), pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.int64()), pa.array([len(c[2]) // 4 for c in cut], pa.int64()), pa.array([zlib.crc32(c[2]) for c in cut], pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array([np.frombuffer(c[2], "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Bins stand in lists by the room they have left; a bit mask of the rooms in use finds the tightest one.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return where, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of three families of dual-feasible functions: f(x) sums to 1 at most over any bin."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.float64)
    x = np.arange(capacity + 1)
    best = (count * x).sum() / capacity
    for k in range(1, 33):  # rounding down to multiples of 1/k, but for exact multiples of 1/(k+1)
        best = max(best, (count * np.where((k + 1) * x % capacity == 0, x / capacity, ((k + 1) * x // capacity) / k)).sum())
    for e in np.unique(np.linspace(1, capacity // 2, 64).astype(int)) if capacity > 1 else []:
        large, middle = count[capacity - e + 1 :].sum(), (count * x)[e : capacity - e + 1].sum() / capacity
        best = max(best, large + np.ceil(middle - 1e-9))
        k = capacity // e
        best = max(best, (count * np.where(2 * x > capacity, 1 - ((capacity - x) // e) / k, np.where(x >= e, 1 / k, 0.0))).sum())
    return int(np.ceil(best - 1e-6))


def pack(rows: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id, offset and certified (the piece's group met its bound) to a table with a column length.

    rows must be stored (read again with the same rows); lengths are 1 to capacity.
    """
    full = rows.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    rest = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType()), T.StructField("_group", T.LongType()), T.StructField("_loose", T.BooleanType())])

    names = rows.columns

    def settle(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            lengths = table.column("length").to_numpy().astype(np.int64)
            group = table.column("_group")[0].as_py()
            where, offset, bins = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            sequence = (level << 56) | (group << 28) | where
            if level:
                old = table.column("sequence_id").to_numpy()
                before = np.unique(old)
                if len(before) <= bins:
                    sequence, offset, bins = old, table.column("offset").to_numpy(), len(before)
            _, number = np.unique(sequence, return_inverse=True)
            fill = np.bincount(number, weights=lengths)
            loose = np.zeros(len(fill), bool)
            if bins > bound and not last:
                loose[np.argsort(fill, kind="stable")[: max(1, min(8 * (bins - bound) + 8, bins // FAN))]] = True
            out = table.select(names)
            for name, column in (("sequence_id", pa.array(sequence, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("certified", pa.array(np.full(len(fill), bins <= bound)[number])), ("_group", pa.array(np.full(len(lengths), group))), ("_loose", pa.array(loose[number]))):
                out = out.append_column(name, column)
            return out

        return run

    now = rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "certified": F.lit(False), "_group": F.pmod(F.xxhash64(*rows.columns), F.lit(groups)), "_loose": F.lit(False)})
    done, level = [full], 0
    while True:
        # level 0 deals rows out afresh; later ones pool the loose bins of FAN neighbours, whole bins each
        now = staged(now.groupBy("_group").applyInArrow(settle(level, groups == 1), schema), f"pack{level}")
        done.append(now.filter(~F.col("_loose")).drop("_group", "_loose"))
        if groups == 1:
            break
        now = now.filter("_loose").withColumn("_group", F.floor(F.col("_group") / FAN))
        groups, level = -(-groups // FAN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, group_rows: int = GROUP_ROWS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each one gets."""
    return pack(staged(pieces(docs, path, id_col, text_col, capacity, end_id, keep_ids), "pieces"), capacity, group_rows)
