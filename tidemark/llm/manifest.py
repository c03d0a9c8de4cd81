"""Operator 12: a Merkle manifest of a dataset, by cogrouped subtree exchange.

Each row is a leaf: the SHA-256 of its fields.  The leaves of a group (a source) stand in order; every fan_out
consecutive ones become the hash of their digests, and so on up to the group's subroot; the subroots, in order of their
groups, likewise give the root.  A proof is the digests beside the way from a leaf to the root.

Rows are numbered by a range partitioning that deals a hot group over many tasks: a row's place is its number in the
partition and what earlier partitions hold of the group.  A superblock is ``fan_out ** levels`` consecutive nodes.  Going
up, each superblock is reduced to one node, round by round.  Going down, the nodes of a superblock and the one row of
outer nodes that it needs (the siblings above it) are cogrouped by superblock: one task call reduces the block again,
joins the inner and the outer part of every proof, and folds.  No call holds more than a superblock and a path.

A null field is ``-``, any other its length in bytes, ``:`` and its value, so no two rows of different fields have one
encoding.  Null groups and ids come first.  Rows of equal id go by their leaves; equal leaves change places without
effect, and are dealt by row number, so that any number of them is no hot key.  Texts are hashed whole, whatever their
length.  An empty table gives an empty one.  Further columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(values: Sequence[Column]) -> Column:
    """The fields as one text: ``-`` for null, else bytes, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, fan_out: int) -> int:
    """Hashings until one of n nodes remains."""
    found = 0
    while n > 1:
        n, found = -(-n // fan_out), found + 1
    return found


class Block:
    """A superblock of consecutive nodes (hex digests), reduced by some levels, and the outer siblings above it."""

    def __init__(self, nodes: list[str], rounds: int, fan_out: int, outer: list[tuple[str, str]] = []):
        self.levels, self.fan_out, self.outer = [nodes], fan_out, outer
        for _ in range(rounds):
            last = self.levels[-1]
            self.levels.append([sha("".join(last[i : i + fan_out])) for i in range(0, len(last), fan_out)])
        self.beside = cache(self._beside)
        self.siblings = cache(self._siblings)
        self.folded = cache(self._folded)

    def _beside(self, level: int, i: int) -> tuple[str, str]:
        """Digests before and after node i in its run."""
        a = i - i % self.fan_out
        run = "".join(self.levels[level][a : a + self.fan_out])
        return run[: 64 * (i - a)], run[64 * (i - a + 1) :]

    def path(self, i: int) -> list[tuple[str, str]]:
        return [self.beside(k, i // self.fan_out**k) for k in range(len(self.levels) - 1)] + self.outer

    def _siblings(self, level: int, i: int) -> str:
        """All siblings from this level up to the root, left to right."""
        if level == len(self.levels) - 1:
            return "".join(a + b for a, b in self.outer)
        return "".join(self.beside(level, i)) + self.siblings(level + 1, i // self.fan_out)

    def _folded(self, level: int, i: int, digest: str) -> str:
        """The root that the digest at node i leads to."""
        if level < len(self.levels) - 1:
            a, b = self.beside(level, i)
            return self.folded(level + 1, i // self.fan_out, sha(a + digest + b))
        for a, b in self.outer:
            digest = sha(a + digest + b)
        return digest


def pack(path: list[tuple[str, str]]) -> bytes:
    """Digests before and after the way, level by level, with their counts."""
    return b"".join(len(x).to_bytes(4, "big") + bytes.fromhex(x) for pair in path for x in pair)


def unpack(raw: bytes) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big") // 2
        found.append(raw[at + 4 : at + 4 + n].hex())
        at += 4 + n
    return list(zip(found[::2], found[1::2]))


def numbered(df: DataFrame, tree: str, order: Sequence[str], scratch: list[str], name: str) -> DataFrame:
    """df with ``place``, the row's number (from 0) in its tree by order, and ``size``, the tree's rows.

    The window over a tree has a row per partition; the rows themselves are sorted by range only.  The staged table
    fixes their partitions, as another sampling might cut elsewhere.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), name, scratch)
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33))
    parts = dealt.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.min("_row").alias("_head"), F.count("*").alias("_rows"))
    mine = Window.partitionBy("_tree")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(mine.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("size", F.sum("_rows").over(mine))
    found = dealt.join(parts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("place", F.col("_before") + F.col("_row") - F.col("_head")).drop("_row", "_part", "_tree", "_of", "_head", "_rows", "_before")


def grown(nodes: DataFrame, fan_out: int, levels: int, scratch: list[str], name: str) -> list[DataFrame]:
    """Nodes (tree, place, size, digest) by round: the given ones, then one per superblock, to one per tree."""
    block = fan_out**levels
    kind = nodes.schema["tree"].dataType.simpleString()

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        size = int(rows["size"].iloc[0])
        up = Block([x.hex() for x in rows["digest"]], min(levels, depth(size, fan_out)), fan_out)
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "size": [-(-size // block)], "digest": [bytes.fromhex(up.levels[-1][0])]})

    found, largest = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        now = found[-1].select("tree", "place", "size", "digest").groupBy("tree", F.floor(F.col("place") / block).alias("block"))
        found.append(staged(now.applyInPandas(reduce, f"tree {kind}, place long, size long, digest binary"), name, scratch))
        largest = -(-largest // block)
    return found


def _blocks(nodes: DataFrame, block: int) -> tuple[DataFrame, Column, Column]:
    return nodes.withColumn("block", F.floor(F.col("place") / block)), F.col("tree"), F.col("block")


def _keyed(outer: DataFrame):
    """Outer rows by superblock; new names, as both sides may stem from one table."""
    return outer.select(F.col("tree").alias("of"), F.col("block").alias("at"), "path", "subroot", "root").groupBy("of", "at")


def handed_down(rounds: list[DataFrame], top: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """What the superblocks of the lowest round need: (tree, block, path, subroot, root).

    top: (tree, path, subroot, root) of every tree's last node.
    """
    block = fan_out**levels
    kind = rounds[0].schema["tree"].dataType.simpleString()
    outer = top.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")

    def exchange(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        if not len(nodes):
            return pd.DataFrame({"tree": [], "block": [], "path": [], "subroot": [], "root": []})
        above = outer.iloc[0]
        here = Block([x.hex() for x in nodes["digest"]], min(levels, depth(int(nodes["size"].iloc[0]), fan_out)), fan_out, unpack(above["path"]))
        return pd.DataFrame({"tree": [key[0]] * len(nodes), "block": nodes["place"].to_numpy(), "path": [pack(here.path(i)) for i in range(len(nodes))], "subroot": [above["subroot"]] * len(nodes), "root": [above["root"]] * len(nodes)})

    # rounds above the leaves; the last one has a node per tree, which top speaks for
    for nodes in rounds[-2:0:-1]:
        nodes, *keys = _blocks(nodes, block)
        outer = nodes.groupBy(*keys).cogroup(_keyed(outer)).applyInPandas(exchange, f"tree {kind}, block long, path binary, subroot binary, root binary")
    return outer


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: Mapping[str, Column] | None = None, fan_out: int = 16, levels: int = 3, proofs: bool = False
) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified (digests as lowercase hex).

    changed: column -> what a later copy of the dataset holds there; folded_root is recomputed from that copy's leaf and
    the siblings of this one, verified says if it is the root.  A row is unchanged where the value is.
    proofs: also ``proof``, per level the digests before and after the way, each as one text.
    """
    block, scratch, done = fan_out**levels, [], []
    column = lambda c: F.col(f"`{c}`")
    leaf = lambda of: F.unhex(F.sha2(encoded(of).cast("binary"), 256))
    # read once: only digests and keys go on; ids as text, which pandas keeps exactly beside nulls
    narrow = docs.select(
        column(group_col).alias("tree"), column(id_col).alias("id"), leaf([column(c) for c in fields]).alias("digest"),
        leaf([(changed or {}).get(c, column(c)) for c in fields]).alias("later"), F.monotonically_increasing_id().alias("salt"),
    )
    if changed is None:
        narrow = narrow.withColumn("later", F.col("digest"))
    narrow = narrow.withColumn("later", F.when(F.col("later") != F.col("digest"), F.col("later")))
    leaves = numbered(staged(narrow, "manifest-leaves", done), "tree", ("id", "digest", "salt"), scratch, "manifest-order")
    rounds = grown(leaves, fan_out, levels, scratch, "manifest-nodes")
    # the root's tree: one row per group, numbered in the groups' order
    subroots = rounds[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = numbered(subroots, "tree", ("group",), scratch, "manifest-groups")
    above = grown(subroots, fan_out, levels, scratch, "manifest-above")
    root = above[-1].select("tree", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    kind = docs.schema[group_col].dataType.simpleString()

    def paths(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        if not len(nodes):
            return pd.DataFrame({"tree": [], "path": [], "subroot": [], "root": []})
        here = Block([x.hex() for x in nodes["digest"]], min(levels, depth(int(nodes["size"].iloc[0]), fan_out)), fan_out, unpack(outer["path"].iloc[0]))
        return pd.DataFrame({"tree": nodes["group"].to_numpy(), "path": [pack(here.path(i)) for i in range(len(nodes))], "subroot": nodes["digest"].to_numpy(), "root": [outer["root"].iloc[0]] * len(nodes)})

    nodes, *keys = _blocks(above[0], block)
    top = nodes.groupBy(*keys).cogroup(_keyed(handed_down(above, root, fan_out, levels))).applyInPandas(paths, f"tree {kind}, path binary, subroot binary, root binary")

    def finish(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        if not len(nodes):
            return pd.DataFrame({c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if proofs else []))})
        above, hexed = outer.iloc[0], [x.hex() for x in nodes["digest"]]
        here = Block(hexed, min(levels, depth(int(nodes["size"].iloc[0]), fan_out)), fan_out, unpack(above["path"]))
        root, subroot = above["root"].hex(), above["subroot"].hex()
        folded = [here.folded(0, i, hexed[i] if later is None else later.hex()) for i, later in enumerate(nodes["later"])]
        found = {
            "id": nodes["id"].to_numpy(), "leaf": hexed, "subroot": subroot, "root": root,
            "proof_sha256": [sha(here.siblings(0, i)) for i in range(len(nodes))], "folded_root": folded, "verified": [x == root for x in folded],
        }
        return pd.DataFrame(found | ({"proof": [[{"before": a, "after": b} for a, b in here.path(i)] for i in range(len(nodes))]} if proofs else {}))

    nodes, *keys = _blocks(leaves.withColumn("id", F.col("id").cast("string")), block)
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<before:string,after:string>>" * proofs
    found = nodes.groupBy(*keys).cogroup(_keyed(handed_down(rounds, top, fan_out, levels))).applyInPandas(finish, schema)
    discard(docs.sparkSession, done)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *(c for c in found.columns if c != "id"))
