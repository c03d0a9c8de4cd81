"""Tree models that Spark ML lacks: extremely randomised trees, and boosting of all classes at once.

Both grow level by level.  A pass over the stored training rows sums statistics per open node inside each partition
(numpy over Arrow batches), Spark adds these up, and the driver chooses the splits; what it holds is bounded by the model
(trees, nodes, candidate features, bins), not by the rows.  Every draw is a hash of seed, tree, node and feature or of
seed, round and row, so a lost task redone gives the same numbers.

Rows: ``features`` (vector), a class index, a weight.  NaN goes left at every cut.  Rows of weight 0 count for nothing
but for the fewest rows of a leaf.  No rows at all give equal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import staged


def draw(*parts) -> np.ndarray:
    """Uniform numbers in [0, 1), one per element of the broadcast parts (integers)."""
    state = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = np.asarray(p).astype(np.int64).view(np.uint64) if np.ndim(p) else np.uint64(int(p) & (2**64 - 1))
            state = (state ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            state = (state ^ (state >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            state = state ^ (state >> np.uint64(32))
    return (state >> np.uint64(11)).astype(np.float64) / 2.0**53


def training_rows(train: DataFrame, label: Column, weight: str | None = "weight") -> DataFrame:
    """Stored rows x (array), y (class index), w and key (a number of the row's own)."""
    rows = train.select(vector_to_array("features").alias("x"), label.cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    return staged(rows.withColumn("key", F.monotonically_increasing_id()), "tree-rows")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node (root 0, children 2i+1 and 2i+2) that each row reaches; feature -1 ends the way."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
    return node


class ExtraTrees:
    """Classification trees whose cuts are drawn at random between a node's least and largest value of a feature.

    At each node the features are drawn in a random order; of the first ``2 * sqrt(features)`` the first
    ``sqrt(features)`` that are not constant there get one random cut each, and the cut of the largest fall in Gini
    impurity splits the node.  All trees see all rows.  A level of all trees takes two passes: values' bounds per node
    and feature, then class weights by side.
    """

    def __init__(self, trees: int = 100, depth: int = 8, min_leaf: int = 4, classes: int = 3, seed: int = 7):
        self.trees, self.depth, self.min_leaf, self.classes, self.seed = trees, depth, min_leaf, classes, seed

    def fit(self, rows: DataFrame) -> ExtraTrees:
        """rows: as training_rows gives them."""
        first = rows.select("x").first()
        self.width = width = len(first["x"]) if first else 0
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.trees, nodes), -1, np.int32)
        self.cut = np.zeros((self.trees, nodes))
        self.value = np.full((self.trees, nodes, self.classes), 1 / self.classes)
        self.gains = np.zeros(max(width, 1))
        if not width:
            return self
        tries = max(1, int(np.sqrt(width)))
        tree, node = np.arange(self.trees), np.zeros(self.trees, np.int64)  # the open nodes
        for level in range(self.depth):
            pool = np.argsort(draw(self.seed, 1, tree[:, None], node[:, None], np.arange(width)[None, :]), axis=1)[:, : min(width, 2 * tries)]
            lo, hi = self._bounds(rows, level, tree, node, pool)
            varies = lo < hi
            rank = np.cumsum(varies, axis=1)
            chosen = varies & (rank <= tries)
            cut = lo + np.where(varies, hi - lo, 0.0) * draw(self.seed, 2, tree[:, None], node[:, None], pool)
            cut = np.where(cut < hi, cut, lo)  # rounding may reach the largest value
            order = np.argsort(~chosen, axis=1, kind="stable")[:, :tries]
            pool, cut, chosen = (np.take_along_axis(a, order, 1) for a in (pool, cut, chosen))
            tree, node = self._split(rows, level, tree, node, pool, cut, chosen)
            if not len(tree):
                break
        return self

    def _passed(self, rows: DataFrame, level: int, tree: np.ndarray, node: np.ndarray, columns: int, step, merge: Sequence) -> np.ndarray:
        """For each open node a row of numbers: step gives those of a batch's rows in one tree, sorted by node."""
        feature, cut, width, count = self.feature, self.cut, self.width, len(tree)
        place = np.full(self.feature.shape, -1, np.int64)
        place[tree, node] = np.arange(count)
        ufuncs = [{"min": np.minimum, "max": np.maximum, "sum": np.add}[m] for m in merge]
        empty = np.array([{"min": np.inf, "max": -np.inf, "sum": 0.0}[m] for m in merge])
        groups = [(m, np.array([i for i, n in enumerate(merge) if n == m])) for m in dict.fromkeys(merge)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.tile(empty, (count, 1)), np.zeros(count, bool)
            for batch in batches:
                x, y, w = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for t in np.unique(tree):
                    at = place[t, _walk(x, feature[t], cut[t], level)]
                    order = np.argsort(at, kind="stable")
                    order = order[np.searchsorted(at[order], 0) :]  # rows in closed nodes have no place
                    if not len(order):
                        continue
                    at = at[order]
                    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    found = step(x[order], y[order], w[order], at)
                    for m, mine in groups:
                        part = ufuncs[mine[0]].reduceat(found[:, mine], heads, axis=0)
                        spot = np.ix_(at[heads], mine)
                        total[spot] = ufuncs[mine[0]](total[spot], part)
                    seen[at] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(total[at, i]) for i in range(columns))], names=["at", *(f"v{i}" for i in range(columns))])

        parts = rows.select("x", "y", "w").mapInArrow(run, "at long, " + ", ".join(f"v{i} double" for i in range(columns)))
        summed = parts.groupBy("at").agg(*(getattr(F, m)(f"v{i}").alias(f"v{i}") for i, m in enumerate(merge))).toArrow()
        out = np.tile(empty, (count, 1))
        out[summed["at"].to_numpy()] = np.column_stack([summed[f"v{i}"].to_numpy() for i in range(columns)])
        return out

    def _bounds(self, rows: DataFrame, level: int, tree: np.ndarray, node: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = pool.shape[1]

        def step(x, y, w, at):
            x = np.take_along_axis(x, pool[at], 1)
            missing = np.isnan(x)
            return np.concatenate([np.where(missing, np.inf, x), np.where(missing, -np.inf, x)], axis=1)

        found = self._passed(rows, level, tree, node, 2 * n, step, ["min"] * n + ["max"] * n)
        return found[:, :n], found[:, n:]

    def _split(self, rows: DataFrame, level: int, tree: np.ndarray, node: np.ndarray, pool: np.ndarray, cut: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, n = self.classes, pool.shape[1]

        def step(x, y, w, at):
            own = np.zeros((len(y), k + 1))
            own[np.arange(len(y)), y] = w
            own[:, k] = 1
            right = (np.take_along_axis(x, pool[at], 1) > cut[at])[:, :, None] * own[:, None, :]
            return np.concatenate([own, right.reshape(len(y), -1)], axis=1)

        found = self._passed(rows, level, tree, node, (n + 1) * (k + 1), step, ["sum"] * ((n + 1) * (k + 1))).reshape(len(tree), n + 1, k + 1)
        whole, right = found[:, 0], found[:, 1:]
        left = whole[:, None] - right
        if level == 0:
            self._set_value(tree, node, whole)
        impure = lambda s: s[..., :k].sum(-1) - (s[..., :k] ** 2).sum(-1) / np.maximum(s[..., :k].sum(-1), 1e-300)
        gain = impure(whole)[:, None] - impure(left) - impure(right)
        gain = np.where(chosen & (left[..., k] >= self.min_leaf) & (right[..., k] >= self.min_leaf), gain, -1.0)
        best = gain.argmax(1)
        r = np.arange(len(tree))
        ok = gain[r, best] > 1e-12 * np.maximum(whole[:, :k].sum(1), 1e-300)
        tree, node, best, r = tree[ok], node[ok], best[ok], r[ok]
        self.feature[tree, node], self.cut[tree, node] = pool[r, best], cut[r, best]
        np.add.at(self.gains, pool[r, best], gain[r, best])
        self._set_value(tree, 2 * node + 1, left[r, best])
        self._set_value(tree, 2 * node + 2, right[r, best])
        trees, children = np.concatenate([tree, tree]), np.concatenate([2 * node + 1, 2 * node + 2])
        sides = np.concatenate([left[r, best], right[r, best]])
        more = (sides[:, k] >= 2 * self.min_leaf) & ((sides[:, :k] > 0).sum(1) > 1)
        return trees[more], children[more]

    def _set_value(self, tree: np.ndarray, node: np.ndarray, sums: np.ndarray) -> None:
        total = sums[:, : self.classes].sum(1, keepdims=True)
        self.value[tree, node] = np.where(total > 0, sums[:, : self.classes] / np.maximum(total, 1e-300), 1 / self.classes)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        for t in range(self.trees):
            out += self.value[t, _walk(x, self.feature[t], self.cut[t], self.depth)]
        return out / self.trees

    def importances(self) -> np.ndarray:
        return self.gains / max(self.gains.sum(), 1e-300)

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node that a row can reach, and the parameters as a row of tree -1."""
        reached = np.zeros(self.feature.shape, bool)
        reached[:, 0] = True
        for node in range(self.feature.shape[1] // 2):
            reached[:, 2 * node + 1] = reached[:, 2 * node + 2] = reached[:, node] & (self.feature[:, node] >= 0)
        t, n = np.nonzero(reached)
        table = pa.table({"tree": t, "node": n, "feature": self.feature[t, n].astype(np.int64), "cut": self.cut[t, n], "value": pa.array(self.value[t, n].tolist(), pa.list_(pa.float64()))})
        spark.createDataFrame(table).unionByName(_parameters(spark, [self.trees, self.depth, self.min_leaf, self.classes, self.seed, self.width, *self.gains])).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ExtraTrees:
        table = spark.read.parquet(path).toArrow().to_pandas()
        p = list(table[table.tree == -1]["value"].iloc[0])
        out = ExtraTrees(*map(int, p[:5]))
        out.width, out.gains = int(p[5]), np.array(p[6:])
        nodes = 2 ** (out.depth + 1) - 1
        out.feature, out.cut = np.full((out.trees, nodes), -1, np.int32), np.zeros((out.trees, nodes))
        out.value = np.full((out.trees, nodes, out.classes), 1 / out.classes)
        table = table[table.tree >= 0]
        t, n = table.tree.to_numpy(), table.node.to_numpy()
        out.feature[t, n], out.cut[t, n], out.value[t, n] = table.feature, table.cut, np.array(table["value"].tolist())
        return out


def _parameters(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(-1, 0, 0, 0.0, [float(v) for v in values])], "tree long, node long, feature long, cut double, value array<double>")


class Boosting:
    """Gradient boosting of the softmax loss: each round grows one regression tree per class on the residuals.

    Features are binned by approximate quantiles once.  A level of a round's trees takes one pass: sums of weight,
    weighted residual and curvature per class, node, feature and bin.  Splits have the largest fall in squared error,
    leaves a Newton step.  A row's scores are stored anew every STORE rounds; trees since then are applied in the pass.
    """

    STORE = 15

    def __init__(self, rounds: int = 100, rate: float = 0.045, depth: int = 3, min_leaf: int = 5, subsample: float = 0.85, classes: int = 3, bins: int = 32, seed: int = 7):
        self.rounds, self.rate, self.depth, self.min_leaf, self.subsample, self.classes, self.bins, self.seed = rounds, rate, depth, min_leaf, subsample, classes, bins, seed

    def fit(self, rows: DataFrame) -> Boosting:
        k, inner = self.classes, 2**self.depth - 1
        first = rows.select("x").first()
        self.width = width = len(first["x"]) if first else 0
        self.start = np.zeros(k)
        self.feature = np.full((0, k, inner), -1, np.int32)
        self.cut, self.leaf = np.zeros((0, k, inner)), np.zeros((0, k, inner + 1))
        self.losses: list[float] = []
        self.gains = np.zeros(max(width, 1))
        if not width:
            return self
        shares = [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)).alias(f"c{c}") for c in range(k)]
        steps = [i / self.bins for i in range(1, self.bins)]
        row = rows.agg(*shares, *(F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), steps, 10_000).alias(f"q{i}") for i in range(width))).first()
        prior = np.array([row[f"c{c}"] for c in range(k)])
        self.start = np.log(np.maximum(prior / max(prior.sum(), 1e-300), 1e-12))
        edges = [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(width)]
        data = self._stored(rows, edges)
        stored, bin_ = 0, np.zeros((0, k, inner), np.int64)
        for r in range(self.rounds):
            feature, place, leaf = np.full((k, inner), -1, np.int32), np.zeros((k, inner), np.int64), np.zeros((k, inner + 1))
            since = (self.feature[stored:], bin_[stored:], self.leaf[stored:])
            for level in range(self.depth):
                if not self._level(data, since, feature, place, leaf, level, r, edges):
                    break
            cut = np.array([[edges[f][b] if f >= 0 else 0.0 for f, b in zip(fs, bs)] for fs, bs in zip(feature, place)])
            self.feature, self.cut, self.leaf = np.concatenate([self.feature, feature[None]]), np.concatenate([self.cut, cut[None]]), np.concatenate([self.leaf, leaf[None]])
            bin_ = np.concatenate([bin_, place[None]])
            if r + 1 - stored == self.STORE and r + 1 < self.rounds:
                data = self._rescored(data, (self.feature[stored:], bin_[stored:], self.leaf[stored:]))
                stored = r + 1
        return self

    def _stored(self, rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
        width, start = self.width, self.start.tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(0), width)
                # NaN has no edge below
                bins = np.column_stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(edges[i], x[:, i], side="left")) for i in range(width)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in bins], pa.binary()), *b.columns[1:], pa.array([start] * len(x), pa.list_(pa.float64()))], names=["bins", "y", "w", "key", "score"])

        return staged(rows.select("x", "y", "w", "key").mapInArrow(run, "bins binary, y int, w double, key long, score array<double>"), "boost-rows")

    def _rescored(self, data: DataFrame, since: tuple) -> DataFrame:
        width, k = self.width, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = _matrix(b.column(4), k) + _votes(_bytes(b.column(0), width), *since)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), k).cast(pa.list_(pa.float64()))], names=["bins", "y", "w", "key", "score"])

        return staged(data.mapInArrow(run, data.schema), "boost-rows")

    def _level(self, data: DataFrame, since: tuple, feature: np.ndarray, place: np.ndarray, leaf: np.ndarray, level: int, r: int, edges: list[np.ndarray]) -> bool:
        """Splits the nodes of a level of round r's trees in place; False if none was."""
        k, width, bins, nodes, first = self.classes, self.width, self.bins, 2**level, 2**level - 1
        subsample, seed, min_leaf = self.subsample, self.seed, self.min_leaf
        sizes = np.array([len(e) for e in edges])

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((4, width, k * nodes * bins)), np.zeros(2)
            for b in batches:
                x, y, w, key = _bytes(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
                score = _matrix(b.column(4), k) + _votes(x, *since)
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                loss += (-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum(), w.sum())
                drawn = draw(seed, 3, r, key) < subsample
                x, y, w, p = x[drawn], y[drawn], w[drawn], p[drawn]
                for c in range(k):
                    res = (y == c) - p[:, c]
                    node = _reached(x, feature[c], place[c], level) - first
                    open_ = node >= 0
                    at = (c * nodes + node[open_]) * bins
                    values = (w[open_], (w * res)[open_], (w * np.abs(res) * (1 - np.abs(res)))[open_], np.ones(open_.sum()))
                    for f in range(width):
                        spot = at + x[open_, f]
                        for s, v in enumerate(values):
                            total[s, f] += np.bincount(spot, v, k * nodes * bins)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([loss.tolist(), *total.transpose(1, 0, 2).reshape(width, -1).tolist()], pa.list_(pa.float64()))], names=["feature", "sums"])

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            f = key[0].as_py()
            sums = np.sum([np.asarray(v) for v in table["sums"].to_pylist()], axis=0)
            if f < 0:
                rows = [(f, 0, 0, 0, 0.0, sums.tolist())]
            else:
                s = sums.reshape(4, k, nodes, bins)
                left = np.cumsum(s, axis=3)
                right = left[..., -1:] - left
                gain = left[0] * right[0] / np.maximum(left[0] + right[0], 1e-300) * (left[1] / np.maximum(left[0], 1e-300) - right[1] / np.maximum(right[0], 1e-300)) ** 2
                allowed = (left[3] >= min_leaf) & (right[3] >= min_leaf) & (np.arange(bins) < sizes[f])
                gain = np.where(allowed, gain, -1.0)
                best = gain.argmax(2)
                rows = [(f, c, n, int(best[c, n]), float(gain[c, n, best[c, n]]), [*left[:3, c, n, best[c, n]], *right[:3, c, n, best[c, n]]]) for c in range(k) for n in range(nodes)]
            names = ["feature", "class", "node", "bin", "gain", "sides"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
            return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows), kinds)})

        parts = data.mapInArrow(collect, "feature int, sums array<double>")
        found = parts.groupBy("feature").applyInArrow(choose, "feature int, class int, node int, bin int, gain double, sides array<double>").toArrow().to_pylist()
        if level == 0:
            loss = next((x["sides"] for x in found if x["feature"] < 0), [0.0, 0.0])
            self.losses.append(loss[0] / max(loss[1], 1e-300))
        best: dict[tuple[int, int], dict] = {}
        for x in sorted((x for x in found if x["feature"] >= 0 and x["gain"] > 1e-15), key=lambda x: (x["gain"], -x["feature"])):
            best[x["class"], x["node"]] = x
        step = lambda s: self.rate * (k - 1) / k * s[1] / s[2] if s[2] > 1e-150 else 0.0
        for (c, n), x in best.items():
            node = first + n
            feature[c, node], place[c, node] = x["feature"], x["bin"]
            self.gains[x["feature"]] += x["gain"]
            # all leaves below a child have its step until a deeper split sets theirs
            span = 2 ** (self.depth - level - 1)
            for side, sums in ((0, x["sides"][:3]), (1, x["sides"][3:])):
                a = (2 * n + side) * span
                leaf[c, a : a + span] = step(sums)
        return bool(best)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for r in range(len(self.feature)):
            for c in range(self.classes):
                out[:, c] += self.leaf[r, c, _leaf(x, self.feature[r, c], self.cut[r, c], self.depth)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def importances(self) -> np.ndarray:
        return self.gains / max(self.gains.sum(), 1e-300)

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per tree: tree is round * classes + class; value holds features, cuts and leaves."""
        inner = 2**self.depth - 1
        rows = [(r * self.classes + c, 0, 0, 0.0, [*map(float, self.feature[r, c]), *map(float, self.cut[r, c]), *map(float, self.leaf[r, c])]) for r in range(len(self.feature)) for c in range(self.classes)]
        head = _parameters(spark, [self.rounds, self.rate, self.depth, self.min_leaf, self.subsample, self.classes, self.bins, self.seed, self.width, inner, *self.start, *self.gains])
        (spark.createDataFrame(rows, head.schema).unionByName(head) if rows else head).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosting:
        table = spark.read.parquet(path).orderBy("tree").collect()
        p = table[0]["value"]
        out = Boosting(int(p[0]), p[1], int(p[2]), int(p[3]), p[4], int(p[5]), int(p[6]), int(p[7]))
        k, inner = out.classes, int(p[9])
        out.width, out.start, out.gains, out.losses = int(p[8]), np.array(p[10 : 10 + k]), np.array(p[10 + k :]), []
        v = np.array([r["value"] for r in table[1:]]).reshape(-1, k, 3 * inner + 1)
        out.feature, out.cut, out.leaf = v[..., :inner].astype(np.int32), v[..., inner : 2 * inner], v[..., 2 * inner :]
        return out


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)


def _reached(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """The node of a level that each row reaches; -1 if its way ended above."""
    node = _walk(x, feature, cut, level)
    return np.where(node >= 2**level - 1, node, -1)


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row; a way that ended above has its leftmost leaf."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
    return node - (2**depth - 1)


def _votes(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    rounds, k, inner = feature.shape
    depth = int(inner + 1).bit_length() - 1
    out = np.zeros((len(x), k))
    for r in range(rounds):
        for c in range(k):
            out[:, c] += leaf[r, c, _leaf(x, feature[r, c], cut[r, c], depth)]
    return out


def predicted(df: DataFrame, model: ExtraTrees | Boosting, out: str = "probability") -> DataFrame:
    """df with the class probabilities of column ``features`` as an array."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def probabilities(x: pd.Series) -> pd.Series:
        matrix = np.stack(x.to_list()).astype(float) if len(x) else np.zeros((0, 1))
        return pd.Series(list(shared.value.probabilities(matrix)))

    return df.withColumn(out, probabilities(vector_to_array("features")))


def log_loss(df: DataFrame, y: str = "y", classes: Sequence[str] = ("low", "medium", "high")) -> float | None:
    """Mean loss of p_<class>."""
    true = reduce(lambda a, c: F.when(F.col(y) == c, F.col(f"p_{c}")).otherwise(a), classes, F.lit(None).cast("double"))
    return df.agg(F.avg(-F.ln(F.greatest(true, F.lit(1e-12))))).first()[0]
