"""k-means of many folds and starts in one pass per step.

A pass assigns every row of a fold to the nearest centre of each start that still moves, in the fold's own scale, and
sums rows per centre inside each partition; Spark adds these up, and the driver moves the centres (folds x starts x k).
First centres are the rows of least hash, so a start is the same wherever the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.trees import _matrix, draw


def kmeans_folds(rows: DataFrame, scales: Sequence[tuple[Sequence[float], Sequence[float]]], k: int = 2, starts: int = 16, iterations: int = 120, seed: int = 1, medians: Sequence[Sequence[float]] | None = None) -> list[np.ndarray]:
    """For each fold the k centres (scaled, ordered) of the start of least cost; fewer where a fold has fewer rows.

    rows: x (array; NaN where there is no value), e (fold at which the row enters, from 1), key (a number of its own);
    stored.  scales: mean and deviation of each column, per fold; medians (else the means) stand in for NaN.
    """
    folds, width = len(scales), len(scales[0][0])
    mean, deviation = np.array([s[0] for s in scales]), np.array([s[1] for s in scales])
    middle = mean if medians is None else np.array(medians)
    scaled = lambda x, f: (np.where(np.isnan(x), middle[f], x) - mean[f]) / deviation[f]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        for b in batches:
            x, e, key = _matrix(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy()
            for s in range(starts):
                for f in range(folds):
                    own = np.flatnonzero(e <= f + 1)
                    h = draw(seed, 5, f, s, key[own])
                    for i in np.argsort(h, kind="stable")[:k]:
                        best.setdefault((f, s), []).append((float(h[i]), int(key[own[i]]), x[own[i]].tolist()))
        items = [(f, s, *one) for (f, s), v in best.items() for one in sorted(v)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([i[j] for i in items], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["f", "s", "h", "key", "x"])

    first = rows.select("x", "e", "key").mapInArrow(nearest, "f int, s int, h double, key long, x array<double>")
    first = first.groupBy("f", "s").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "key", "x"))), 1, k).alias("c")).collect()
    centres = np.full((folds, starts, k, width), np.inf)
    for r in first:
        for j, c in enumerate(r["c"]):
            centres[r["f"], r["s"], j] = scaled(np.array(c["x"]), r["f"])
    cost = np.full((folds, starts), np.inf)
    moving = np.isfinite(centres).all(3).any(2)
    for _ in range(iterations):
        if not moving.any():
            break
        now, active = centres.copy(), np.argwhere(moving)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(active), k, width + 2))
            for b in batches:
                x, e = _matrix(b.column(0), width), b.column(1).to_numpy()
                for f in np.unique(active[:, 0]):
                    z = scaled(x[e <= f + 1], f)
                    if not len(z):
                        continue
                    for i in np.flatnonzero(active[:, 0] == f):
                        c = now[f, active[i, 1]]
                        d = ((z[:, None, :] - np.where(np.isfinite(c), c, 1e150)[None]) ** 2).sum(2)
                        near = d.argmin(1)
                        for j in range(k):
                            mine = near == j
                            total[i, j, :width] += z[mine].sum(0)
                            total[i, j, width] += mine.sum()
                            total[i, j, width + 1] += d[mine, j].sum()
            flat = total.reshape(len(active) * k, width + 2)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), *(pa.array(flat[:, j]) for j in range(width + 2))], names=["at", *(f"v{j}" for j in range(width + 2))])

        parts = rows.select("x", "e").mapInArrow(step, "at int, " + ", ".join(f"v{j} double" for j in range(width + 2)))
        found = parts.groupBy("at").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(width + 2))).toArrow()
        sums = np.zeros((len(active) * k, width + 2))
        sums[found["at"].to_numpy()] = np.column_stack([found[f"v{j}"].to_numpy() for j in range(width + 2)])
        sums = sums.reshape(len(active), k, width + 2)
        for i, (f, s) in enumerate(active):
            n = sums[i, :, width]
            # a centre that lost its rows stays
            moved = np.where(n[:, None] > 0, sums[i, :, :width] / np.maximum(n, 1)[:, None], now[f, s])
            cost[f, s] = sums[i, :, width + 1].sum()
            moving[f, s] = not np.allclose(moved, now[f, s], rtol=0, atol=1e-9)
            centres[f, s] = moved
    out = []
    for f in range(folds):
        c = centres[f, int(np.argmin(cost[f]))]
        c = c[np.isfinite(c).all(1)]
        out.append(c[np.lexsort(c.T[::-1])])
    return out


def regime(columns: Sequence[str], medians: Sequence[float], scale: tuple[Sequence[float], Sequence[float]], centres: np.ndarray) -> Column:
    """``regime_<n>`` of the nearest centre, the first of equals; null without centres."""
    z = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(a)) / float(d) for c, m, a, d in zip(columns, medians, *scale)]
    if not len(centres):
        return F.lit(None).cast("string")
    square = lambda c: sum(((x - float(v)) * (x - float(v)) for x, v in zip(z[1:], c[1:])), (z[0] - float(c[0])) * (z[0] - float(c[0])))
    nearest = F.least(*(F.struct(square(c).alias("d"), F.lit(n).alias("n")) for n, c in enumerate(centres))) if len(centres) > 1 else F.struct(F.lit(0).alias("n"))
    return F.concat(F.lit("regime_"), nearest["n"].cast("string"))
