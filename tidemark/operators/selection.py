"""Exact order statistics of many columns, for nested sets of rows (folds) at once, by counts of ranges.

Rows enter at a fold and stay in all later ones, as the train parts of an expanding walk-forward do; without folds all
enter at 1.  Equal values of a column are counted before any exchange, dealt by range into parts (Spark's own sampled
bounds, as many as the session has shuffle partitions), and stored.  Counts and moments by part and entry have prefix
sums that tell in which part a wanted rank lies, and the values of these parts alone are sorted.  The driver holds
columns x parts x folds counts and the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite
from tidemark.sources.shared import staged

def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


class Selection:
    """Counts of the finite values of columns by part and fold, and the values at ranks."""

    def __init__(self, df: DataFrame, columns: Sequence[str], entry: Column | None = None, folds: int = 1, parts: int | None = None):
        self.columns, self.folds = list(columns), folds
        entry = F.lit(1) if entry is None else entry
        wide = df.select(entry.cast("int").alias("_e"), *((finite(F.col(c)) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(self.columns)))  # -0.0 and 0.0 are one value
        lines = wide.unpivot(["_e"], [f"v{i}" for i in range(len(self.columns))], "_name", "_x").filter("_x is not null and _e is not null")
        counts = lines.groupBy("_name", "_e", "_x").agg(F.count("*").alias("_n"))
        dealt = counts.repartitionByRange("_name", "_x") if parts is None else counts.repartitionByRange(parts, "_name", "_x")
        self.lines = staged(dealt.withColumn("_part", F.spark_partition_id()), "lines")
        found = self.lines.groupBy("_name", "_part", "_e").agg(F.sum("_n").alias("n"), F.min("_x").alias("lo")).collect()
        #: column -> its parts, in order
        self.parts = {c: sorted({r["_part"] for r in found if r["_name"] == f"v{i}"}) for i, c in enumerate(self.columns)}
        #: column -> rows by part and fold, summed over folds up to each
        self.counts = {c: np.zeros((len(p), folds)) for c, p in self.parts.items()}
        least: dict[tuple[str, int], float] = {}
        for r in found:
            c = self.columns[int(r["_name"][1:])]
            self.counts[c][self.parts[c].index(r["_part"]), r["_e"] - 1] += r["n"]
            least[c, r["_part"]] = min(r["lo"], least.get((c, r["_part"]), math.inf))
        self.counts = {c: t.cumsum(axis=1) for c, t in self.counts.items()}
        #: column -> a value in its middle; moments are taken about it, so that sums of squares lose no digits
        self.pivot = {c: self._middle([(n, least[c, p]) for p, n in zip(self.parts[c], self.counts[c][:, -1])]) for c in self.columns}

    @cached_property
    def table(self) -> dict[str, np.ndarray]:
        """column -> (sums of x, x * x, log, log * log about the pivot; part; fold), summed over folds up to each."""
        x, log, n = F.col("_x") - self._pivot(), self._log(), F.col("_n")
        sums = self.lines.groupBy("_name", "_part", "_e").agg(F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.sum(n * log).alias("l"), F.sum(n * log * log).alias("ll"))
        out = {c: np.zeros((4, len(p), self.folds)) for c, p in self.parts.items()}
        for r in sums.collect():
            c = self.columns[int(r["_name"][1:])]
            out[c][:, self.parts[c].index(r["_part"]), r["_e"] - 1] += (r["x"], r["xx"], r["l"], r["ll"])
        return {c: t.cumsum(axis=2) for c, t in out.items()}

    @staticmethod
    def _middle(parts: list[tuple[int, float]]) -> float:
        half = sum(n for n, _ in parts) / 2
        for n, lo in parts:
            half -= n
            if half <= 0:
                return lo
        return 0.0

    def _pivot(self) -> Column:
        found = F.lit(0.0)
        for i, c in enumerate(self.columns):
            found = F.when(F.col("_name") == f"v{i}", self.pivot[c]).otherwise(found)
        return found

    def _log(self) -> Column:
        return signed_log(F.col("_x")) - signed_log(self._pivot())

    def log(self, column: str, value: float) -> float:
        """The signed log of a value, less that of the column's pivot."""
        one = lambda v: math.copysign(math.log1p(abs(v)), v)
        return one(value) - one(self.pivot[column])

    def count(self, column: str, fold: int = 1) -> int:
        """Finite values of the column in the fold."""
        return int(self.counts[column][:, fold - 1].sum())

    def moments(self, column: str, fold: int = 1) -> np.ndarray:
        """Sums of x, x * x, log and log * log (signed logs), about the pivot."""
        return self.table[column][:, :, fold - 1].sum(axis=1)

    def at(self, wanted: Iterable[tuple[str, int, int]], sums: bool = True) -> dict[tuple[str, int, int], tuple[float, float, float]]:
        """(column, fold, rank from 0) -> the value there, and the sums of logs and of squared logs (about the pivot) of all values up to it.

        sums: without them, only the values are right.
        """
        spark, asked = self.lines.sparkSession, {}
        for c, fold, rank in set(wanted):
            n = self.counts[c][:, fold - 1]
            ends = n.cumsum()
            part = int(np.searchsorted(ends, rank, side="right"))
            asked[c, fold, rank] = (part, rank - int(ends[part] - n[part]))
        if not asked:
            return {}
        rows = [(f"v{self.columns.index(c)}", self.parts[c][p], fold, rank, local) for (c, fold, rank), (p, local) in asked.items()]
        # as many rows as ranks are asked for
        targets = spark.createDataFrame(rows, "_name string, _part int, _fold int, _rank long, _local long")
        places = targets.select("_name", "_part", "_fold").distinct()
        near = self.lines.join(F.broadcast(places), ["_name", "_part"]).filter("_e <= _fold").groupBy("_name", "_part", "_fold", "_x").agg(F.sum("_n").alias("_n"))
        log, up = self._log(), Window.partitionBy("_name", "_part", "_fold").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        near = near.select("*", F.sum("_n").over(up).alias("_to"), F.sum(F.col("_n") * log).over(up).alias("_l"), F.sum(F.col("_n") * log * log).over(up).alias("_ll"))
        hit = near.join(F.broadcast(targets), ["_name", "_part", "_fold"]).filter("_local < _to and _local >= _to - _n")
        over = F.col("_to") - F.col("_local") - 1  # copies of the value behind the rank
        out = {}
        for r in hit.select("_name", "_fold", "_rank", "_part", "_x", (F.col("_l") - over * log).alias("l"), (F.col("_ll") - over * log * log).alias("ll")).collect():
            c = self.columns[int(r["_name"][1:])]
            before = self.table[c][2:, : self.parts[c].index(r["_part"]), r["_fold"] - 1].sum(axis=1) if sums else (0.0, 0.0)
            out[c, r["_fold"], r["_rank"]] = (r["_x"], before[0] + r["l"], before[1] + r["ll"])
        return out

    def quantiles(self, probabilities: Sequence[float], fold: int = 1) -> dict[str, list[float] | None]:
        """Interpolated quantiles of each column; None without values."""
        places = {c: [p * (self.count(c, fold) - 1) for p in probabilities] for c in self.columns if self.count(c, fold)}
        found = self.at(((c, fold, r) for c, ps in places.items() for p in ps for r in (math.floor(p), math.ceil(p))), sums=False)
        value = lambda c, r: found[c, fold, r][0]
        return {c: [value(c, math.floor(p)) + (p - math.floor(p)) * (value(c, math.ceil(p)) - value(c, math.floor(p))) for p in places[c]] if c in places else None for c in self.columns}


class FoldStatistics:
    """Medians, winsor bounds, and moments of every fold's train rows, from one Selection.

    The bounds are quantiles of the values with nulls at the median, as a fit on the fold's own rows has them; the
    moments are those of the signed logs between the bounds.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], entry: Column, folds: int, lower: float = 0.01, upper: float = 0.99, parts: int | None = None):
        self.selection = s = Selection(df, columns, entry, folds, parts)
        sizes = {r["e"]: r["n"] for r in df.groupBy(entry.cast("int").alias("e")).agg(F.count("*").alias("n")).filter("e is not null").collect()}
        self.rows = np.cumsum([sizes.get(f, 0) for f in range(1, folds + 1)])
        self.columns = list(columns)
        wanted, plans = set(), {}
        for c in columns:
            for fold in range(1, folds + 1):
                n, total = s.count(c, fold), int(self.rows[fold - 1])
                if not n:
                    continue
                middle = (n - 1) / 2
                cut = math.floor(middle) + 1  # nulls at the median stand before this rank
                mapped = lambda r: ("x", r) if r < cut else ("m", cut - 1) if r < cut + total - n else ("x", r - (total - n))  # noqa: B023, E731
                ends = [(mapped(math.floor(p)), mapped(math.ceil(p)), p - math.floor(p)) for p in (lower * (total - 1), upper * (total - 1))]
                plans[c, fold] = (n, total, middle, ends)
                wanted |= {(c, fold, r) for r in (math.floor(middle), math.ceil(middle), *(r for a, b, _ in ends for _, r in (a, b)))}
        found = s.at(wanted)
        #: (column, fold) -> value
        self.medians, self.bounds, self.means, self.scales = {}, {}, {}, {}
        for (c, fold), (n, total, middle, ends) in plans.items():
            a, b = found[c, fold, math.floor(middle)][0], found[c, fold, math.ceil(middle)][0]
            median = a + (middle - math.floor(middle)) * (b - a)
            value = lambda kind, r: median if kind == "m" else found[c, fold, r][0]  # noqa: B023, E731
            low, high = (value(*p) + share * (value(*q) - value(*p)) for p, q, share in ends)
            # ranks up to first are at most low, from last on at least high; what lies between comes from running sums
            first, (kind, r) = ends[0][0][1], ends[1][1]
            log = lambda v: s.log(c, v)  # noqa: B023, E731
            x1, l1, ll1 = found[c, fold, r]
            last, l, ll = (r, l1 - log(x1), ll1 - log(x1) ** 2) if kind == "x" else (r + 1, l1, ll1)
            if last > first:
                l, ll = l - found[c, fold, first][1], ll - found[c, fold, first][2]
            else:  # one row
                last, l, ll = first + 1, 0.0, 0.0
            inner = last - first - 1
            if not inner:
                l, ll = 0.0, 0.0
            tails = [(first + 1, log(low)), (n - last, log(high)), (total - n, log(min(max(median, low), high)))]
            mean = (l + sum(k * v for k, v in tails)) / total
            square = ll - 2 * mean * l + inner * mean * mean + sum(k * (v - mean) ** 2 for k, v in tails)
            self.medians[c, fold], self.bounds[c, fold] = float(median), (float(low), float(high))
            self.means[c, fold] = float(mean + math.copysign(math.log1p(abs(s.pivot[c])), s.pivot[c]))
            scale = math.sqrt(max(square, 0.0) / (total - 1)) if total > 1 else 0.0
            self.scales[c, fold] = scale if scale > 1e-12 * max(1.0, abs(self.means[c, fold])) else 0.0  # rounding of a constant

    def filled_moments(self, column: str, fold: int) -> tuple[float, float]:
        """Mean and population deviation of the values with nulls at the median (deviation 0: 1)."""
        total, n = int(self.rows[fold - 1]), self.selection.count(column, fold)
        if not n:
            return 0.0, 1.0
        pivot = self.selection.pivot[column]
        median, (x, xx, _, _) = self.medians[column, fold] - pivot, self.selection.moments(column, fold)
        mean = (x + (total - n) * median) / total
        square = xx - 2 * mean * x + n * mean * mean + (total - n) * (median - mean) ** 2
        deviation = math.sqrt(max(square, 0.0) / total)
        return float(mean + pivot), deviation if deviation > 1e-12 * max(1.0, abs(mean + pivot)) else 1.0
