"""Operator 8: removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller id.

Suffixes are dealt into buckets, and a task sorts one bucket at a time:

1. ``_emit``: the bucket of the suffix at a place is the smallest hash of the 16-byte strings inside its first
   ``window`` bytes, so equal strings meet in one bucket.  Neighbouring places mostly share that string; such
   a run of places is shipped as two hashes (bucket, content), never as text.  Equal runs of one batch
   are settled there: all but those of the smallest id are covered.
2. ``_resolve``: runs of a bucket with equal content are covered but for the smallest id.  Different runs of
   several documents are mixed, some of their places equal, others not, if they agree in the bucket's string and half of a window's
   other bytes to its left or to its right (16-bit hashes); others have no window in common, and are left alone.
3. ``_mark``: documents meet the decisions on them; mixed runs send their bytes to their buckets.
4. ``_sort``: each bucket of bytes is suffix-sorted: by 16 bytes first, and longer ties by ranks of a
   difference-cover sample's whole suffixes, computed before by doubling.  Neighbours that agree in ``window`` bytes are one
   string, covered but for its smallest id.
5. ``_finish``: documents meet the covered spans, and the rest is kept.

Texts cross the network twice, as compressed blocks.  A copied passage costs one run per batch and place, so
hot passages are pre-aggregated before any shuffle, and no bucket holds a text more than once per batch.

Null text counts as empty.  A null id counts as larger than all others.  Rows with equal ids do not cover
each other; equal ids with different texts are told apart by a hash of the text.  Repeated rows get a result each.
Whole texts are read, however long; one shorter than the window is left as it is.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import bounded_batches, kept_names, mix64, named, release_memory, slices, staged, utf8

K = 16
#: Text behind one bucket task, behind one group of documents, and settled at a time by the first pass.
BUCKET_BYTES, GROUP_BYTES, EMIT_BYTES = 12 << 20, 8 << 20, 16 << 20
#: A difference cover of 16: any two residues have an offset below 16 that takes both into it.
COVER = (0, 1, 2, 5, 8)
PERIOD = 16
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_OFFSET = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
_BIG = np.iinfo(np.int64).max
#: Sides of runs that are no hashes.
NO_SIDE, ANY_SIDE = 0, 0xFFFF
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
#: Columns of blocks: of documents, of entries (a place and what starts there), and of text.  Each is one value's bytes after another's.
_KINDS = {"id": "<i8", "tag": "<u4", "first": "u1", "pos": "<u4", "size": "u1", "span": "<u4", "bucket_hi": "<u4", "bucket_lo": "<u2", "content_hi": "<u4", "content_lo": "<u2", "left": "<u2", "right": "<u2", "text": "u1"}
_COUNTS = {"docs": ("id", "tag"), "chars": ("text",)}
_COUNT_OF = {c: next((k for k, names in _COUNTS.items() if c in names), "entries") for c in _KINDS}
_BLOCK = "docs int, entries int, chars int, " + ", ".join(f"{c} binary" for c in _KINDS)
_DECISIONS = f"dg int, mixed boolean, {_BLOCK}"
#: Bytes of a column of a block from which on it is compressed.
SMALL = 512


def dump(**columns: np.ndarray) -> bytes:
    """Arrays as one compressed Arrow block."""
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    return dump_table(table)


def dump_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def load_table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def load(raw: bytes) -> dict[str, np.ndarray]:
    table = load_table(raw)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _words(blob: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (views at all places)."""
    padded = np.zeros(len(blob) + 8, np.uint8)
    padded[: len(blob)] = blob
    return np.ndarray((len(blob) + 1,), "<u8", buffer=padded, strides=(1,))


def _offsets(window: int) -> list[int]:
    return [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]


def _sliding_least(g: np.ndarray, width: int, n: int) -> np.ndarray:
    """The least of width values from each of the first n places on."""
    have = 1
    while 2 * have <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    if have < width:
        g = np.minimum(g[:n], g[width - have : width - have + n])
    return g


def _digest(load8: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """16-bit hashes, neither NO_SIDE nor ANY_SIDE, of the length bytes from each place on."""
    h = np.zeros(len(at), np.uint64)
    for o in _offsets(length):
        h = (h ^ load8[at + o]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (mix64(h) % np.uint64(ANY_SIDE - 1) + np.uint64(1)).astype(np.uint16)


def runs(blob: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of window places with one bucket: first place, number of places, bucket hash and content hash (48 bits each), sides.

    The bucket's string lies in all windows of a run.  Every window reaches half of its other bytes beyond it to the left
    or to the right, so two runs have a window in common only if those that reach left agree there, or those that reach right.
    The sides are hashes of the string with that half; NO_SIDE where no window reaches so far; ANY_SIDE where the
    string occurs more than once near the run, so that windows may differ in which one they mean.
    """
    n, none = len(blob), np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint16), none.astype(np.uint16)
    load8 = _words(blob)
    g = load8[: n - K + 1] * np.uint64(0x9E3779B97F4A7C15) + load8[8 : n - K + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    # the low bits tell the string's place: of equal strings in a window the first and the last in the order of these bits
    low = np.uint64((1 << (window - K).bit_length()) - 1)
    nth = np.arange(len(g), dtype=np.uint64) & low
    g &= ~low
    width, places = window - K + 1, n - window + 1
    last_g = _sliding_least(g | (low - nth), width, places)
    g = _sliding_least(g | nth, width, places)
    twice = ((g + last_g) & low) != low
    valid = np.ones(len(g), bool)
    ends = np.unique(offsets[1:])
    over = (ends[:, None] - np.arange(1, window)).ravel()
    valid[over[(over >= 0) & (over < len(g))]] = False
    change = np.empty(len(g), bool)
    change[0] = True
    change[1:] = ((g[1:] ^ g[:-1]) > low) | ~valid[:-1]
    start = np.flatnonzero(valid & change)
    last = np.empty(len(g), bool)
    last[-1] = True
    last[:-1] = change[1:] | ~valid[1:]
    size = np.flatnonzero(valid & last) + 1 - start
    # a run whose windows mean several places
    moved = np.zeros(len(g), bool)
    moved[1:] = (g[1:] != g[:-1]) & ~change[1:]
    moved |= twice
    seen = np.concatenate([[0], np.cumsum(moved, dtype=np.int64)])
    several = seen[start + size] > seen[start]
    most = min(48, window)
    parts = -(-size // most)
    if len(parts) and parts.max() > 1:  # periodic texts
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - nth * most, most)
        start, several = np.repeat(start, parts) + nth * most, np.repeat(several, parts)
    content = np.zeros(len(start), np.uint64)
    for at in (start, start + size - 1):
        for o in _offsets(window):
            content = (content ^ load8[at + o]) * np.uint64(0x9E3779B97F4A7C15)
            content ^= content >> np.uint64(31)
    half = (window - K) // 2
    ahead = ((g[start] - start.astype(np.uint64)) & low).astype(np.int64)  # from the first place to the string
    left, right = np.full(len(start), NO_SIDE, np.uint16), np.full(len(start), NO_SIDE, np.uint16)
    reach = np.flatnonzero(~several & (ahead >= half))
    left[reach] = _digest(load8, start[reach] + ahead[reach] - half, half + K)
    reach = np.flatnonzero(~several & (ahead - size + 1 < half))
    right[reach] = _digest(load8, start[reach] + ahead[reach], window - half + 1)
    left[several] = right[several] = ANY_SIDE
    return start, size, mix64(g[start] | low) >> np.uint64(16), mix64(content + size.astype(np.uint64)) >> np.uint64(16), left, right


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_BIG).to_numpy(zero_copy_only=False)


def _tags(blob: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(blob[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint32)


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _packed(column: np.ndarray, cuts: list[int]) -> list[bytes]:
    """The bytes between the cuts.  As small blocks grow with the square of the input, one costs a copy and nothing more."""
    raw, w, out = memoryview(np.ascontiguousarray(column)).cast("B"), column.itemsize, []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = raw[a * w : b * w]
        small = part if len(part) < SMALL else pa.compress(part, "zstd", asbytes=True)
        out.append(bytes(small if len(small) < len(part) else part))
    return out


def _joined(column: pa.ChunkedArray, counts: list[int], kind: str) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(v if len(v) == n * w else pa.decompress(v, n * w, "zstd", asbytes=True) for v, n in zip(column.to_pylist(), counts)), kind)


def _blocks(name: str, key: np.ndarray, order: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, text: np.ndarray | None = None, chars: np.ndarray | None = None, **more: np.ndarray) -> pa.Table:
    """One row per key, named so, with its entries in that order: places as differences, hashes of 48 bits in two columns.

    A document's consecutive entries share its id and tag.  text is in that order already, chars bytes to an entry.
    """
    key, ids, tags, pos = key[order], ids[order], tags[order], pos[order].astype(np.uint32)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = new.copy()
    first[1:] |= (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    step = pos.copy()
    step[1:] -= np.where(first[1:], np.uint32(0), pos[:-1])
    columns = {"id": ids[first], "tag": tags[first], "first": first.view(np.uint8), "pos": step}
    for k, x in more.items():
        x = x[order]
        columns |= {f"{k}_hi": (x >> np.uint64(16)).astype(np.uint32), f"{k}_lo": (x & np.uint64(0xFFFF)).astype(np.uint16)} if k in ("bucket", "content") else {k: x.astype(_KINDS[k])}
    starts = np.flatnonzero(new)
    cuts = {"entries": np.append(starts, len(key)), "docs": np.append((np.cumsum(first) - 1)[starts], len(columns["id"])), "chars": np.zeros(len(starts) + 1, np.int64)}
    if text is not None:
        columns["text"] = text
        cuts["chars"] = np.concatenate([[0], np.cumsum(chars)])[cuts["entries"]]
    out = {name: pa.array(key[starts], pa.int32())} | {c: pa.array(np.diff(cuts[c]), pa.int32()) for c in ("docs", "entries", "chars")}
    cuts = {k: x.tolist() for k, x in cuts.items()}
    return pa.table(out | {c: pa.array(_packed(columns[c], cuts[_COUNT_OF[c]]), pa.binary()) if c in columns else pa.nulls(len(starts), pa.binary()) for c in _KINDS})


def _read_blocks(table: pa.Table) -> dict[str, np.ndarray]:
    """The columns of all entries, and text; empty if there are no rows."""
    if not table.num_rows:
        return {}
    counts = {c: table.column(c).to_pylist() for c in ("docs", "entries", "chars")}
    y = {c: _joined(table.column(c), counts[_COUNT_OF[c]], kind) for c, kind in _KINDS.items() if not table.column(c).null_count}
    doc = np.cumsum(y["first"], dtype=np.int64) - 1
    total, head = np.cumsum(y["pos"], dtype=np.uint32), np.flatnonzero(y["first"])
    x = {"id": y["id"][doc], "tag": y["tag"][doc], "pos": (total - (total - y["pos"])[head][doc]).astype(np.int64)}
    x |= {c: y[c].astype(np.int64) for c in ("size", "span") if c in y} | {c: y[c] for c in ("left", "right", "text") if c in y}
    return x | {c: (y[f"{c}_hi"].astype(np.uint64) << np.uint64(16)) | y[f"{c}_lo"] for c in ("bucket", "content") if f"{c}_hi" in y}


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(key[part[0]]), part


def _emit(window: int, buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (part for batch in batches for part in slices(batch, 1, EMIT_BYTES)):
            found, ids, tags, base = [], [], [], 0
            for batch in slices(whole, 1, 2 << 20):
                blob, offsets = utf8(batch.column(1))
                start, size, bucket, content, left, right = runs(blob, offsets, window)
                doc = np.searchsorted(offsets, start, side="right") - 1
                found.append((doc + base, start - offsets[doc], size, bucket, content, left, right))
                ids.append(_ids(batch.column(0)))
                tags.append(_tags(blob, offsets))
                base += batch.num_rows
            if not found:
                continue
            doc, pos, size, bucket, content, left, right = map(np.concatenate, zip(*found))
            ids, tags = np.concatenate(ids), np.concatenate(tags)
            # settle equal runs of this batch: the smallest id stays
            order = np.lexsort((ids[doc], content, bucket))
            b, c, i = bucket[order], content[order], ids[doc[order]]
            new = np.ones(len(order), bool)
            new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            covered = np.zeros(len(order), bool)
            if len(order):
                covered[order] = i > i[new][np.cumsum(new) - 1]
            for at, key, hashes in (
                (np.flatnonzero(covered), lambda at: buckets + _group(ids[doc[at]], groups), {}),
                (np.flatnonzero(~covered), lambda at: (bucket[at] % np.uint64(buckets)).astype(np.int64), {"bucket": bucket, "content": content, "left": left, "right": right}),
            ):
                # entries are in the order of documents and places
                out = _blocks("key", key(at), np.argsort(key(at).astype(np.uint16 if buckets + groups < 1 << 16 else np.int64), kind="stable"), ids[doc[at]], tags[doc[at]], pos[at], size=size[at], **{k: x[at] for k, x in hashes.items()})
                yield from out.to_batches()

    return run


def _decide(ids, tags, pos, size, groups, mixed, **more) -> pa.Table:
    """Rows of _DECISIONS, one per group of documents."""
    g = _group(ids, groups)
    out = _blocks("dg", g, np.lexsort((pos, tags, ids, g)), ids, tags, pos, size=size, **more)
    return out.add_column(1, "mixed", pa.array([mixed] * out.num_rows, pa.bool_()))


def _several(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether another id has the same key."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(new)
    out = np.empty(len(key), bool)
    out[order] = (np.minimum.reduceat(ids[order], at) < np.maximum.reduceat(ids[order], at))[np.cumsum(new) - 1]
    return out


def _may_share(bucket: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a run of another document, none of equal content, may have a window in common with each run.

    It is in the same bucket and has the same left side, or the same right side; or one of the bucket has ANY_SIDE.
    """
    out = np.zeros(len(bucket), bool)
    if not len(out):
        return out
    loose = np.zeros(int(bucket.max()) + 1, bool)
    loose[bucket[left == ANY_SIDE]] = True
    for part, side in ((np.flatnonzero(loose[bucket]), None), (np.flatnonzero(left), left), (np.flatnonzero(right), right)):
        if len(part):
            out[part] |= _several(bucket[part] << 16 | (side[part].astype(np.int64) if side is not None else 0), ids[part])
    return out


def _resolve(buckets: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        release_memory()
        key = table.column("key")[0].as_py()
        if key >= buckets:  # settled in their batch
            return table.set_column(0, "dg", pa.array([key - buckets] * table.num_rows, pa.int32())).add_column(1, "mixed", pa.array([False] * table.num_rows, pa.bool_()))
        x = _read_blocks(table)
        order = np.argsort(x["bucket"], kind="stable")
        b = x["bucket"][order]
        same = np.zeros(len(b) + 1, bool)
        same[1:-1] = b[1:] == b[:-1]
        keep = order[same[1:] | same[:-1]]
        keep = keep[np.lexsort((x["id"][keep], x["content"][keep], x["bucket"][keep]))]
        x = {k: v[keep] for k, v in x.items()}
        if not len(keep):
            return _decide(x["id"], x["tag"], x["pos"], x["size"], groups, False)
        new_bucket = np.ones(len(keep), bool)
        new_bucket[1:] = x["bucket"][1:] != x["bucket"][:-1]
        new_class = new_bucket.copy()
        new_class[1:] |= x["content"][1:] != x["content"][:-1]
        covered = x["id"] > x["id"][new_class][np.cumsum(new_class) - 1]
        mixed = np.flatnonzero(~covered)
        mixed = mixed[_may_share(np.cumsum(new_bucket)[mixed], x["id"][mixed], x["left"][mixed], x["right"][mixed])]
        settled = _decide(x["id"][covered], x["tag"][covered], x["pos"][covered], x["size"][covered], groups, False)
        return pa.concat_tables([settled, _decide(x["id"][mixed], x["tag"][mixed], x["pos"][mixed], x["size"][mixed], groups, True, bucket=x["bucket"][mixed])])

    return run


#: Rows of documents by group: a record batch, compressed, with its length before it, and its schema apart.
_PACKED = "dg int, rows binary, bytes int, schema binary"


def _pack(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw, size = [], [], []
            for g, part in _split(_group(_ids(batch.column(0)), groups)):
                rows = batch.take(pa.array(part)).serialize()
                keys.append(g)
                size.append(rows.size)
                raw.append(pa.compress(rows, "zstd", asbytes=True))
            schema = batch.schema.serialize().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(raw, pa.binary()), pa.array(size, pa.int32()), pa.array([schema] * len(keys), pa.binary())], names=["dg", "rows", "bytes", "schema"])
            release_memory()

    return run


def unpack(table: pa.Table) -> pa.Table:
    """The rows of a group, of which there is one at least."""
    schema = pa.ipc.read_schema(pa.py_buffer(table.column("schema")[0].as_py()))
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(r, n, "zstd"), schema) for r, n in zip(table.column("rows").to_pylist(), table.column("bytes").to_pylist())])


def _place(ids: np.ndarray, tags: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which row each entry belongs to (for equal rows: one of them), and whether there is one."""
    order = np.lexsort((tags, ids))
    sorted_ids, sorted_tags = ids[order], tags[order]
    at = np.searchsorted(sorted_ids, x["id"])
    same = np.flatnonzero(np.searchsorted(sorted_ids, x["id"], side="right") - at > 1)
    if len(same):  # rows of one id are told apart by their tags
        table = np.rec.fromarrays([sorted_ids, sorted_tags])
        at[same] = np.searchsorted(table, np.rec.fromarrays([x["id"][same], x["tag"][same]]).astype(table.dtype))
    at = np.minimum(at, max(len(ids) - 1, 0))
    return order[at], (sorted_ids[at] == x["id"]) & (sorted_tags[at] == x["tag"])


def _covered(offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte ranges in the joined texts; ranges of different rows stay apart."""
    n = int(offsets[-1])
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, offsets[row] + start, 1)
    np.add.at(depth, offsets[row] + end, -1)
    inside = np.cumsum(depth[:-1]) > 0
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_MARKED = f"key int, whole boolean, {_BLOCK}"
#: Bytes of text copied at a time.
_PIECE = 1 << 20


def _marked(out: pa.Table, whole: bool) -> pa.Table:
    return out.add_column(1, "whole", pa.array([whole] * out.num_rows, pa.bool_()))


def _texts(blob: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bytes from each place on, joined."""
    end = np.cumsum(n)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    cuts = np.searchsorted(end, np.arange(0, len(out) + _PIECE, _PIECE)) if len(end) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            m, base = n[a:b], end[a] - n[a]
            at = np.repeat(start[a:b] - (end[a:b] - m - base), m)
            out[base : end[b - 1]] = blob[at + np.arange(len(at))]
    return out


def _mark(window: int, buckets: int, groups: int, text: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        none = np.zeros(0, np.int64)
        out = []
        if left.num_rows and right.num_rows:
            docs = unpack(left)
            ids = _ids(docs.column(0).combine_chunks())
            blob, offsets = utf8(docs.column(text))
            tags = _tags(blob, offsets)
            for mixed in (False, True):
                x = _read_blocks(right.filter(pc.equal(right.column("mixed"), mixed)))
                if not x:
                    continue
                row, there = _place(ids, tags, x)
                if not there.all():
                    raise ValueError("a decision without its document")
                if mixed:
                    key = (x["bucket"] % np.uint64(buckets)).astype(np.int64)
                    order = np.lexsort((x["pos"], row, key))
                    n = (x["size"] + window - 1)[order]
                    texts = _texts(blob, (offsets[row] + x["pos"])[order], n)
                    out.append(_marked(_blocks("key", key, order, x["id"], x["tag"], x["pos"], texts, n, size=x["size"], bucket=x["bucket"]), True))
                else:
                    begin, end = _covered(offsets, row, x["pos"], x["pos"] + x["size"] + window - 1)
                    row = np.searchsorted(offsets, begin, side="right") - 1
                    out.append(_spans(np.full(len(row), left.column("dg")[0].as_py()), ids[row], tags[row], begin - offsets[row], end - offsets[row]))
        return pa.concat_tables(out) if out else _spans(none, none, none.astype(np.uint32), none, none)

    return run


def _spans(group: np.ndarray, ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    return _marked(_blocks("key", group, np.lexsort((start, tags, ids, group)), ids, tags, start, span=end - start), False)


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of the texts from them on, to at least depth bytes; texts end in zeros without end.

    Ties of 16 bytes are resolved by ranks of the places whose residue is in the difference cover: places of
    one residue by the rank at their first such place, residues among each other by the offset common to both.
    Ranks are those of whole suffixes: ranks of a bounded length would compare different pairs of residues to
    different ends, which is no order, and places would get lost.
    """
    padded = np.zeros(len(text) + 2 * PERIOD + 16, np.uint8)
    padded[: len(text)] = text
    load8 = np.ndarray((len(padded) - 8,), ">u8", buffer=padded, strides=(1,))

    def head(p):
        _, hi = np.unique(load8[p], return_inverse=True)
        _, both = np.unique((hi.astype(np.uint64) << np.uint64(32)) | np.unique(load8[p + 8], return_inverse=True)[1].astype(np.uint64), return_inverse=True)
        return both

    group = head(at)
    order = np.argsort(group, kind="stable")
    size = np.bincount(group)
    tied = size[group] > 1
    if depth <= PERIOD or not tied.any():
        return order
    sample = np.flatnonzero(_IN_COVER[np.arange(len(text) + PERIOD) % PERIOD])
    # a rank is one more than the number of samples before; zeros to the end are the least
    first = head(sample)
    alike = np.bincount(first)
    rank = np.ones(len(text) + PERIOD + 1, np.int64)
    rank[sample] = 1 + (np.cumsum(alike) - alike)[first]
    open_, have = sample[alike[first] > 1], PERIOD
    while len(open_):  # doubling: equal residues are samples again
        both, number, alike = np.unique((rank[open_] << 32) | rank[np.minimum(open_ + have, len(rank) - 1)], return_inverse=True, return_counts=True)
        old, before = both >> 32, np.cumsum(alike) - alike
        now = old + before - before[np.searchsorted(old, old)]
        if (now == old).all():
            break
        rank[open_] = now[number]
        open_ = open_[alike[number] > 1]
        have *= 2
    begin = np.cumsum(size) - size
    lists = []
    for a in range(PERIOD):
        mine = np.flatnonzero(tied & (at % PERIOD == a))
        key = (group[mine] << 32) | rank[at[mine] + _OFFSET[a, a]]
        lists.append(mine[np.argsort(key, kind="stable")])
    place = np.zeros(len(at), np.int64)
    for a, mine in enumerate(lists):
        if not len(mine):
            continue
        g = group[mine]
        total = np.zeros(len(mine), np.int64)
        for b, other in enumerate(lists):
            if a == b:
                total += np.arange(len(mine)) - np.searchsorted(g, g)
            elif len(other):
                d = _OFFSET[a, b]
                theirs = (group[other] << 32) | rank[at[other] + d]
                total += np.searchsorted(theirs, (g << 32) | rank[at[mine] + d], side="right" if b < a else "left") - np.searchsorted(group[other], g)
        place[mine] = begin[g] + total
    order[place[tied]] = np.flatnonzero(tied)
    return order


def _sort(window: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        release_memory()
        x = _read_blocks(table)
        text = x["text"]
        n = x["size"] + window - 1
        first = np.cumsum(n) - n
        run_of = np.repeat(np.arange(len(n)), x["size"])
        nth = np.arange(len(run_of)) - np.repeat(np.cumsum(x["size"]) - x["size"], x["size"])
        at = first[run_of] + nth
        order = suffix_order(text, at, window)
        padded = _words(text)
        ids, p = x["id"][run_of[order]], at[order]
        new = np.ones(len(p), bool)
        same = np.ones(max(len(p) - 1, 0), bool)
        for o in _offsets(window):
            same &= padded[p[1:] + o] == padded[p[:-1] + o]
        new[1:] = ~same
        covered = np.zeros(len(p), bool)
        if len(p):
            least = np.minimum.reduceat(ids, np.flatnonzero(new))
            covered[order] = ids > least[np.cumsum(new) - 1]
        hit = np.flatnonzero(covered)
        # consecutive covered places of a run become one span
        step = np.ones(len(hit), bool)
        step[1:] = (np.diff(hit) != 1) | (run_of[hit[1:]] != run_of[hit[:-1]])
        begin, end = hit[step], np.append(hit[np.flatnonzero(step)[1:] - 1], hit[-1:])
        r = run_of[begin]
        return _spans(_group(x["id"][r], groups), x["id"][r], x["tag"][r], x["pos"][r] + nth[begin], x["pos"][r] + nth[end] + window)

    return run


def _finish(names: list[str], text: str, out_text: bool, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        if not left.num_rows:
            return schema.empty_table()
        docs = unpack(left)
        ids = _ids(docs.column(0).combine_chunks())
        blob, offsets = utf8(docs.column(text))
        tags = _tags(blob, offsets)
        x = _read_blocks(right)
        spans: dict[tuple[int, int], list] = {}
        if x:
            for i, t, a, n in zip(x["id"].tolist(), x["tag"].tolist(), x["pos"].tolist(), x["span"].tolist()):
                spans.setdefault((i, t), []).append((a, a + n))
        removed, count, sha, kept = [], [], [], []
        for r, (i, t, a, b) in enumerate(zip(ids.tolist(), tags.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())):
            rest, at, gone, n = [], 0, 0, 0
            for s, e in sorted(spans.get((i, t), ())):
                if s > at or not n:
                    if s > at:
                        rest.append(blob[a + at : a + s])
                    n, at, gone = n + 1, e, gone + e - s
                elif e > at:
                    gone, at = gone + e - at, e
            rest.append(blob[a + at : b])
            raw = b"".join(x.tobytes() for x in rest)
            removed.append(gone)
            count.append(n)
            sha.append(hashlib.sha256(raw).hexdigest())
            if out_text:
                kept.append(raw.decode("utf-8", "ignore"))
        out = docs.select(names)
        for name, column in (("n_bytes", pa.array(np.diff(offsets), pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(count, pa.int64())), ("kept_sha256", pa.array(sha, pa.string()))):
            out = out.append_column(name, column)
        if out_text:
            out = out.append_column("kept_text", pa.array(kept, pa.string()))
        return out.cast(schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: tuple[str, ...] = (), kept_text: bool = False, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """id, the columns of keep, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept_text (broken characters left out).

    id_col must be an integer column.  A column of keep that is named like a result comes as ``input_<name>``.
    """
    if window < 24:
        raise ValueError("windows of 24 bytes or more")
    bounded_batches(docs.sparkSession)
    pair = docs.select(id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, groups = max(12, -(-total // bucket_bytes)), max(12, -(-total // group_bytes))
    decisions = pair.mapInArrow(_emit(window, buckets, groups), f"key int, {_BLOCK}").groupBy("key").applyInArrow(_resolve(buckets, groups), _DECISIONS)
    packed = pair.mapInArrow(_pack(groups), _PACKED)
    marked = staged(packed.groupBy("dg").cogroup(decisions.groupBy("dg")).applyInArrow(_mark(window, buckets, groups, text_col), _MARKED), "repeats")
    sorted_ = marked.filter("whole").groupBy("key").applyInArrow(_sort(window, groups), _MARKED)
    spans = marked.filter("not whole").unionByName(sorted_).withColumnRenamed("key", "dg").drop("whole")
    names = kept_names([id_col, text_col, *keep], RESULTS)
    carried = named(docs, names)
    out = [n for c, n in names.items() if c != text_col or c in keep]
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*(carried.schema[c] for c in out), *(T.StructField(n, t) for n, t in list(zip(RESULTS, kinds))[: 4 + kept_text])])
    rows = carried.mapInArrow(_pack(groups), _PACKED)
    return rows.groupBy("dg").cogroup(spans.groupBy("dg")).applyInArrow(_finish(out, names[text_col], kept_text, to_arrow_schema(schema)), schema)
