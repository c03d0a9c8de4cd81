"""Operator 2: near-duplicate classes by ProbMinHash, banding and verification.

The shingles of a text are its runs of five words (all its words, if fewer), with equal weights: links are decided
by sets, and repetition must not part what they join.  ProbMinHash: every shingle is a Poisson process with its weight as rate; each arrival goes to a random
register, which keeps the earliest.  Arrivals are generated up to a time by which the registers are full;
texts with an open register go on to twice that time, all others stop.  Two texts agree in a register with
their probability Jaccard similarity, which for equal weights is the Jaccard similarity of the sets.

Registers are cut into bands.  Texts that share a band are compared: first by a sketch of one bit a register,
then exactly, by the Jaccard similarity of their shingle sets (as 32-bit fingerprints).  Classes are the
connected components of the links at ``threshold`` or more.

Texts with the same words are one node from the start, so exact copies never meet in a bucket.  Words are known by a
digest of 128 bits: a node has half of it as its name, and where the other half differs it is parted.

1. In a bucket all nodes are compared with its smallest node, and small buckets in full.
2. Of the buckets whose nodes are still in different classes, small ones are compared in full, larger ones with
   other nodes of the bucket.
3. Buckets that are still open are cut into blocks of bounded size, and all pairs of blocks are counted exactly,
   in bit matrices of their fingerprints; pairs inside the bucket's largest class are left out.  A pair of blocks gives
   a spanning forest of its links, never all of them.

So no pair that shares a band stays untried.  What step 3 costs grows with the square of the nodes of a bucket that
hang together with none of the others (templated pages just below the threshold).

Null text counts as empty, whole texts are read however long.  Wordless texts are copies of each other only if their
bytes are equal.  Rows with equal or null ids are classed by their texts; repeated rows are rows of one class; a class
is named by its smallest id (null if it has none).  An empty table gives an empty one.  Other columns are not read,
so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, discard, mix64, release_memory, shingle_hashes, slices, span_hashes, staged, utf8, words
from tidemark.llm.graph import connected_components

SHINGLE, BANDS, ROWS = 5, 24, 4
#: Nodes of a bucket that is compared in full, in the first pass and in the second.
SMALL, SMALL_LATER = 6, 32
#: Other nodes that a larger bucket is compared with in the second pass.
STARS = 4
#: Nodes of a block in the third pass, and columns of a token matrix at a time.
BLOCK, COLUMNS = 512, 4096


def shingle_sets(blob: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles: row, hash, times; words per row; and a digest of each row's words (of its bytes, if wordless)."""
    low, starts, ends, first = words(blob, offsets)
    h, bounds = shingle_hashes(span_hashes(low, starts, ends), first, k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    # words joined by a space: the bytes of words, and one space at each word's end
    keep = np.zeros(len(low) + 1, np.int64)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    inside = np.cumsum(keep[:-1]) > 0
    digests = []
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        if first[i + 1] > first[i]:
            text = np.where(inside[a:b], low[a:b], 32).tobytes()
            digests.append(hashlib.md5(b"w" + b" ".join(text.split()), usedforsecurity=False).digest())
        else:
            digests.append(hashlib.md5(b"r" + blob[a:b].tobytes(), usedforsecurity=False).digest())
    return row[at], h[at], np.diff(np.append(at, len(h))), np.diff(first), digests


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """A (rows, registers) array of 32-bit marks of the elements that reached each register first (0 in rows without elements)."""
    mark = np.zeros(rows * registers, np.uint32)
    total = np.bincount(row, weights=weight, minlength=rows)
    until = np.zeros(rows)
    some = total > 0
    until[some] = registers * (np.log(registers) + 1) / total[some]
    while len(row):
        best = np.full(rows * registers, np.inf)
        places, times, marks = [], [], []
        r, e, w, t, j = row, element, weight, np.zeros(len(row)), 0
        while len(r):
            j += 1
            bits = mix64(e + np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            t = t - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            alive = t <= until[r]
            r, e, w, t = r[alive], e[alive], w[alive], t[alive]
            place = r * registers + (mix64(bits[alive]) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(best, place, t)
            places.append(place)
            times.append(t)
            marks.append((e >> np.uint64(32)).astype(np.uint32))
        place, t = np.concatenate(places), np.concatenate(times)
        first = t == best[place]
        mark[place[first]] = np.concatenate(marks)[first]
        unfilled = np.isinf(best.reshape(rows, registers)).any(axis=1)
        again = unfilled[row]
        row, element, weight = row[again], element[again], weight[again]
        until = until * 2
    return mark.reshape(rows, registers)


def _sign(id_type: str, k: int, bands: int, rows: int, node_bytes: int):
    mark = lambda digests, a, b: pa.array([int.from_bytes(d[a:b], "little", signed=True) for d in digests], pa.int64())
    registers = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                row, h, _, n, digests = shingle_sets(*utf8(batch.column(1)), k)
                marks = prob_min_hash(row, h, np.ones(len(h)), batch.num_rows, registers)
                signed = [m.tobytes() if c else None for m, c in zip(marks, n.tolist())]
                # the set as 32-bit fingerprints
                values, cut = (h >> np.uint64(32)).astype(np.uint32), np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
                prints = [np.unique(values[x:y]).tobytes() for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), mark(digests, 0, node_bytes), mark(digests, 8, 16), pa.array(signed, pa.binary()), pa.array(prints, pa.binary())], names=["id", "row", "key", "node", "check", "signature", "prints"])

    return run


def _band(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, bands * rows)
            spread = mix64(marks.astype(np.uint64) + np.arange(marks.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key = np.zeros((len(marks), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for j in range(rows):
                key = mix64(key * np.uint64(0x100000001B3) ^ spread.reshape(-1, bands, rows)[:, :, j])
            bits = (spread & np.uint64(1)).astype(np.uint8)
            packed = np.zeros((len(marks), 16), np.uint8)
            own = np.packbits(bits[:, :128], axis=1)
            packed[:, : own.shape[1]] = own
            sketch = packed.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(np.repeat(sketch[:, 0], bands)), pa.array(np.repeat(sketch[:, 1], bands))],
                names=["bucket", "node", "s0", "s1"],
            )

    return run


def _alike(registers: int, threshold: float):
    """Whether one-bit sketches don't rule out the similarity: five standard deviations below its mean agreement."""
    n = min(registers, 128)
    agree = (1 + threshold) / 2
    least = n * agree - 5 * (n * agree * (1 - agree)) ** 0.5
    return F.lit(n) - F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) - F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) >= least


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def spanning_links(node: np.ndarray, component: np.ndarray, prints: list[np.ndarray], side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the classes of one block (side is constant), or across the two sides.

    The common fingerprints of all pairs are counted in bit matrices, some columns at a time.
    """
    size = np.array([len(p) for p in prints], np.int64)
    owner = np.repeat(np.arange(len(prints)), size)
    value, column, times = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    x, y = (np.flatnonzero(side == v) for v in (side.min(), side.max()))
    common = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((len(prints), COLUMNS), np.uint8)
        has[owner[a:b], column[a:b] - lo] = 1
        bits = np.packbits(has, axis=1).view(np.uint64)
        other = bits[y]
        for i, row in enumerate(bits[x]):
            common[i] += np.bitwise_count(other & row).sum(axis=1, dtype=np.int64)
    linked = common >= threshold * (size[x][:, None] + size[y] - common) - 1e-9
    linked &= component[x][:, None] != component[y]
    # links of one node to many: union by smallest root
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(linked))):
        r, q = find(int(component[x[i]])), find(int(component[y[j]]))
        if r != q:
            parent[max(r, q)] = min(r, q)
            out.append((int(node[x[i]]), int(node[y[j]])))
    return out


def _blocks(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        release_memory()
        node, component, side = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        links = spanning_links(node, component, [np.frombuffer(p, np.uint32) for p in table.column("prints").to_pylist()], side, threshold)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open_links(nodes: DataFrame, prints: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between the classes of each bucket.  nodes: bucket, node, component.

    The largest class of a bucket has blocks of its own, and these are not compared with each other.
    """
    sizes = nodes.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    dealt = nodes.join(main, "bucket").withColumn("in_main", F.col("component") == F.col("main"))
    # blocks of the others come first: 0 to others - 1
    others, mains = (F.ceil(F.col(n) / block).cast("int") for n in ("n_rest", "n_main"))
    dealt = dealt.withColumn("n_rest", F.col("n") - F.col("n_main")).withColumn("others", others).withColumn("mains", mains)
    dealt = dealt.withColumn("block", F.when(F.col("in_main"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    partner = F.when(F.col("in_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    met = dealt.withColumn("partner", F.explode(partner)).select("bucket", "node", "component", "block", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"))
    return met.join(prints, "node").groupBy("bucket", "i", "j").applyInArrow(_blocks(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, node_bytes: int = 8) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of its class) and class_size (rows of the class).

    node_bytes: bytes of a digest of 16 that name a text; the other half tells apart those of one name.
    """
    return _classes(docs, id_col, text_col, threshold, shingle, bands, rows, block, node_bytes=node_bytes).select(F.col("id").alias(id_col), "class_id", "class_size")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs but for near copies: of each class one row of smallest id stays (null ids last)."""
    options = {"threshold": 0.8, "shingle": SHINGLE, "bands": BANDS, "rows": ROWS, "block": BLOCK} | options
    scratch: list[str] = []
    # rows are known by 128 bits of hashes of their columns (of maps, which have none, by those of their JSON)
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    hashed = F.concat(F.hex(F.xxhash64(*values)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *reversed(values))))
    classes = _classes(docs, id_col, text_col, **options, key=hashed, scratch=scratch)
    first = classes.groupBy("component").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "row")).alias(_KEY))
    times = classes.groupBy(F.col("key").alias(_KEY)).agg(F.count("*").alias("times"))
    kept = staged(first.join(times, _KEY), "kept")
    discard(docs.sparkSession, scratch)
    out = docs.withColumn(_KEY, hashed).join(kept.select(_KEY), _KEY, "left_semi")
    if not kept.filter("times > 1").isEmpty():  # rows alike in all columns
        out = out.dropDuplicates([_KEY])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


_KEY = "_near_dedup_key"


def _named_apart(signed: DataFrame, scratch: list[str] | None) -> DataFrame:
    """Rows whose node is that of other words (told by the rest of their digest) get nodes of their own."""
    while True:
        met = signed.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo < hi").select("node", F.lit(True).alias("met"))
        if met.isEmpty():
            return signed
        apart = F.when(F.col("met"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        signed = staged(signed.join(met, "node", "left").withColumn("node", apart).select(signed.columns), "signed", scratch)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, bands: int, rows: int, block: int, key: Column | None = None, scratch: list[str] | None = None, node_bytes: int = 8) -> DataFrame:
    """id, row, key, component, class_id, class_size of every row of docs; scratch gets the tables that these are read from."""
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    registers = bands * rows
    own: list[str] = []
    numbered = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id(), F.lit("") if key is None else key)
    signed = _named_apart(staged(numbered.mapInArrow(_sign(kind, shingle, bands, rows, node_bytes), f"id {kind}, row long, key string, node long, check long, signature binary, prints binary"), "signed", scratch), scratch)
    nodes = signed.groupBy("node").agg(F.min("row").alias("row"), F.first("signature", ignorenulls=True).alias("signature"))
    banded = staged(nodes.filter("signature is not null").select("node", "signature").mapInArrow(_band(bands, rows), "bucket long, node long, s0 long, s1 long"), "bands", own)

    sized = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "s0", "s1")).alias("star")).filter("n > 1")
    shared = staged(banded.join(sized, "bucket"), "buckets", own)
    star = shared.select(F.col("star.node").alias("a"), F.col("star.s0").alias("t0"), F.col("star.s1").alias("t1"), F.col("node").alias("b"), "s0", "s1").filter("a < b").filter(_alike(registers, threshold))
    first = star.select("a", "b").unionByName(_full(shared.filter(f"n > 2 and n <= {SMALL}"), registers, threshold)).distinct()

    # the sets of all nodes that share a bucket, one row of each node
    wanted = shared.select("node").distinct().join(signed.groupBy("node").agg(F.min("row").alias("row")), "node").select("row")
    prints = staged(signed.select("row", "node", "prints").join(wanted, "row").select("node", "prints"), "prints", own)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = prints.select(F.col("node").alias("a"), F.col("prints").alias("x")), prints.select(F.col("node").alias("b"), F.col("prints").alias("y"))
        return staged(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long, linked boolean"), "links", own)

    tried = verified(first)
    classes = connected_components(tried.filter("linked"))
    # second pass: buckets whose nodes are in several classes
    now = shared.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("star", "n")
    open_ = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), *(F.min_by(F.struct("node", "s0", "s1", "component"), F.xxhash64("node", F.lit(j))).alias(f"star{j}") for j in range(STARS))).filter("lo < hi").drop("lo", "hi")
    open_ = staged(now.join(open_, "bucket"), "open", own)
    stars = F.explode(F.array(*(f"star{j}" for j in range(STARS))))
    more = open_.filter(f"n > {SMALL_LATER}").withColumn("star", stars).filter("star.component <> component").select(F.col("star.node").alias("a"), F.col("star.s0").alias("t0"), F.col("star.s1").alias("t1"), F.col("node").alias("b"), "s0", "s1").filter(_alike(registers, threshold))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(_full(open_.filter(f"n <= {SMALL_LATER}"), registers, threshold)).distinct()
    again = verified(more.join(tried, ["a", "b"], "left_anti"))
    links = tried.unionByName(again).filter("linked").select("a", "b")
    classes = connected_components(links)
    # third pass: all pairs of different classes that the stars of larger buckets left untried
    rest = open_.filter(f"n > {SMALL_LATER}").select("bucket", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    still = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    rest = staged(rest.join(still, "bucket", "left_semi").select("bucket", "node", "component"), "rest", own)
    if not rest.isEmpty():
        last = staged(_open_links(rest, prints, threshold, block), "last", own)
        classes = connected_components(links.unionByName(last))

    discard(docs.sparkSession, own)
    rows_ = signed.select("id", "row", "key", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = rows_.groupBy("component").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows_.join(named, "component")


def _full(buckets: DataFrame, registers: int, threshold: float) -> DataFrame:
    """All pairs of small buckets whose sketches are alike."""
    own = buckets.groupBy("bucket").agg(F.collect_list(F.struct("node", "s0", "s1")).alias("all"))
    one = own.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.expr("filter(all, y -> y.node > x.node)")).alias("y"))
    return one.select(F.col("x.node").alias("a"), F.col("x.s0").alias("s0"), F.col("x.s1").alias("s1"), F.col("y.node").alias("b"), F.col("y.s0").alias("t0"), F.col("y.s1").alias("t1")).filter(_alike(registers, threshold)).select("a", "b")
