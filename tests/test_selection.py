"""Exact quantiles, statistics of folds, and clusters of folds against plain computations on each fold's own rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, fit
from tidemark.operators.selection import FoldStatistics, Selection
from tidemark.plans import training


def rows_of(n, seed):
    r = random.Random(seed)
    value = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, r.gauss(0, 10), r.gauss(0, 1), math.exp(r.gauss(0, 3))])
    return [(i, r.choice([None, 1, 2, 3, 4]), value(), r.choice([0.0] * 9 + [r.gauss(0, 1)]), None if r.random() < 0.985 else r.gauss(5, 1), r.choice(["A", "B", None]) if i > 60 else "A") for i in range(n)]


SCHEMA = "id int, e int, a double, b double, c double, sector string"


@pytest.mark.parametrize("n,parts", [(2000, 8), (700, 40), (300, None), (5, 4), (2, 4), (1, None)])
def test_quantiles_equal_the_sorted_values(spark, n, parts):
    rows = rows_of(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Selection(df, ["a", "b", "c"], parts=parts).quantiles([0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0])
    for i, c in enumerate("abc"):
        x = [v for v in (row[2 + i] for row in rows) if v is not None and not math.isnan(v)]
        if not x:
            assert got[c] is None
        else:
            assert np.allclose(got[c], np.quantile(x, [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]), rtol=1e-12, atol=0)


@pytest.mark.parametrize("n,parts", [(1500, 16), (300, 60), (40, None)])
def test_each_fold_equals_a_fit_on_its_own_rows(spark, n, parts):
    df = spark.createDataFrame(rows_of(n, n + 1), SCHEMA).repartition(3).persist()
    pres = training.fold_preprocessors(df, ["a", "b", "c"], ["sector"], 4, "e")
    found = FoldStatistics(df, ["a", "b", "c"], F.col("e"), 4, parts=parts)
    for fold in range(1, 5):
        own = df.filter(F.col("e") <= fold).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abc"})
        want = fit.Preprocessor(["a", "b", "c"], ["sector"]).fit(own)
        one = pres[fold - 1]
        for c in "abc":
            close = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
            assert close(one.medians[c], want.medians[c]) and close(one.means[c], want.means[c]), (fold, c)
            # a constant's deviation is 1 here, and may be the rounding of its mean there
            assert close(one.scales[c], want.scales[c]) or want.scales[c] < 1e-12 and one.scales[c] == 1.0, (fold, c)
            assert all(map(close, one.bounds[c], want.bounds[c]))
            if (c, fold) in found.means:
                assert close(found.means[c, fold], want.means[c])
        assert one.values == want.values
        filled = fit.population_scaler(own.select(*(F.coalesce(F.col(c), F.lit(want.medians[c])).alias(c) for c in "abc")), ["a", "b", "c"])
        for c in "abc":
            assert np.allclose(found.filled_moments(c, fold), filled[c], rtol=1e-9, atol=1e-9)


def test_clusters_of_folds(spark):
    r = random.Random(4)
    points = [([r.gauss(3 * (i % 2), 0.3), r.gauss(0, 1) if i % 9 else float("nan")], 1 + i // 40, i) for i in range(120)]
    rows = spark.createDataFrame(points, "x array<double>, e int, key long").repartition(3).persist()
    scales = [([1.5, 0.0], [1.5, 1.0])] * 3
    got = clusters.kmeans_folds(rows, scales, starts=4, medians=[[0.0, 0.0]] * 3)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, clusters.kmeans_folds(rows.repartition(5), scales, starts=4, medians=[[0.0, 0.0]] * 3)))
    for f, centres in enumerate(got):
        z = (np.array([np.nan_to_num(x) for x, e, _ in points if e <= f + 1]) - [1.5, 0.0]) / [1.5, 1.0]
        near = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert np.allclose(centres, [z[near == j].mean(0) for j in range(2)], atol=1e-6)  # each centre is its rows' mean
        assert (near == (np.arange(len(z)) % 2)).all()
    df = rows.select(F.when(~F.isnan(F.col("x")[0]), F.col("x")[0]).alias("a"), F.when(~F.isnan(F.col("x")[1]), F.col("x")[1]).alias("b"), "key")
    named = df.select("key", clusters.regime(["a", "b"], [0.0, 0.0], scales[2], got[2]).alias("r")).collect()
    assert all(x.r == f"regime_{x.key % 2}" for x in named)


def test_few_rows_have_few_clusters(spark):
    rows = spark.createDataFrame([([1.0], 2, 0)], "x array<double>, e int, key long")
    got = clusters.kmeans_folds(rows, [([0.0], [1.0])] * 2)
    assert got[0].shape == (0, 1) and got[1].tolist() == [[1.0]]
