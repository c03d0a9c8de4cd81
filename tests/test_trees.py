"""Random-cut trees, boosting of all classes, sampling by weight, and the perceptron that learns from it."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import models, trees


def table(spark, n=300, seed=1, parts=3, weights=None):
    """Three classes told by the first feature, less clearly by the second; a constant and a random one; some NaN."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = r.randrange(3)
        x = [y + r.gauss(0, 0.4), -y + r.gauss(0, 1.5), 5.0, r.random()]
        if i % 50 == 0:
            x[1] = float("nan")
        rows.append((i, x, ("low", "medium", "high")[y], y, weights[i] if weights else 1.0))
    df = spark.createDataFrame(rows, "id int, x array<double>, y string, label int, weight double")
    return df.withColumn("features", array_to_vector("x")).repartition(parts, "id")


def matrix(df):
    got = sorted(df.select("id", "x", "label").collect())
    return np.array([r.x for r in got]), np.array([r.label for r in got])


@pytest.fixture(scope="module")
def data(spark):
    return table(spark).persist()


@pytest.fixture(scope="module")
def rows(data):
    return trees.training_rows(data, F.col("label"))


def test_boosting_falls_each_round_and_predicts(spark, data, rows):
    model = trees.Boosting(rounds=17, rate=0.2, subsample=1.0).fit(rows)
    assert len(model.losses) == 17 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    x, y = matrix(data)
    p = model.probabilities(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.9
    # the loss that the passes report is that of the first rounds' trees
    prior = np.bincount(y) / len(y)
    assert math.isclose(model.losses[0], -np.log(prior[y]).mean(), rel_tol=1e-9)
    held = table(spark, 400, seed=9)
    hx, hy = matrix(held)
    q = model.probabilities(hx)
    assert -np.log(q[np.arange(len(hy)), hy]).mean() < 0.6 * math.log(3)
    scored = trees.predicted(held, model).select("id", "probability").collect()
    assert np.allclose(np.array([r.probability for r in sorted(scored)]), q)


def test_first_split_is_the_best_of_all(spark, data, rows):
    model = trees.Boosting(rounds=1, depth=1, subsample=1.0, min_leaf=5, bins=255).fit(rows)
    x, y = matrix(data)
    prior = np.bincount(y, minlength=3) / len(y)
    for c in range(3):
        res = (y == c) - prior[c]
        best = 0.0
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f][~np.isnan(x[:, f])]):
                right = x[:, f] > cut
                if min(right.sum(), (~right).sum()) >= 5:
                    best = max(best, right.mean() * (~right).mean() * (res[right].mean() - res[~right].mean()) ** 2)
        f, cut = model.feature[0, c, 0], model.cut[0, c, 0]
        right = x[:, f] > cut
        mine = right.mean() * (~right).mean() * (res[right].mean() - res[~right].mean()) ** 2
        assert mine > 0.98 * best
        step = 0.045 * 2 / 3 * res[right].sum() / (abs(res[right]) * (1 - abs(res[right]))).sum()
        assert math.isclose(model.leaf[0, c, 1], step, rel_tol=1e-9)


def test_weights_count_like_copies(spark):
    weights = [1.0 + i % 3 for i in range(200)]
    weighted = table(spark, 200, weights=weights)
    copies = weighted.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).withColumn("weight", F.lit(1.0))
    x, _ = matrix(weighted)
    one, two = (trees.Boosting(rounds=4, subsample=1.0, min_leaf=1, bins=255).fit(trees.training_rows(d, F.col("label"))) for d in (weighted, copies))
    assert np.allclose(one.start, two.start)
    assert np.allclose(one.probabilities(x), two.probabilities(x), atol=0.02)
    a, b = (trees.ExtraTrees(5, depth=1, min_leaf=1).fit(trees.training_rows(d, F.col("label"))) for d in (weighted, copies))
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)


def test_stored_scores_change_nothing(rows, monkeypatch):
    whole = trees.Boosting(rounds=5).fit(rows)
    monkeypatch.setattr(trees.Boosting, "STORE", 2)
    again = trees.Boosting(rounds=5).fit(rows)
    assert np.array_equal(whole.feature, again.feature) and np.allclose(whole.leaf, again.leaf) and np.allclose(whole.losses, again.losses)


def test_random_cuts(spark, data, rows):
    one, two = (trees.ExtraTrees(12, depth=5, seed=s).fit(rows) for s in (1, 2))
    x, y = matrix(data)
    assert not np.array_equal(one.cut, two.cut)
    for model in (one, two):
        p = model.probabilities(x)
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.8 and math.isclose(model.importances().sum(), 1)
        assert model.importances()[2] == 0  # the constant is never cut
    # cuts are drawn, not taken from values or the few of a grid
    cuts = one.cut[one.feature == 0]
    assert len(np.unique(cuts)) == len(cuts) > 12 and not np.isin(cuts, x[:, 0]).any()
    for t in range(12):
        assert np.bincount(trees._walk(x, one.feature[t], one.cut[t], 5)).max() <= len(x)
        reached = np.bincount(trees._walk(x, one.feature[t], one.cut[t], 5))
        assert reached[reached > 0].min() >= 4


def test_trees_do_not_depend_on_partitions(spark, rows):
    other = trees.ExtraTrees(6, depth=4).fit(rows.repartition(5))
    one = trees.ExtraTrees(6, depth=4).fit(rows)
    assert np.array_equal(one.feature, other.feature) and np.allclose(one.cut, other.cut) and np.allclose(one.value, other.value)


def test_saved_models_predict_the_same(spark, data, rows, tmp_path):
    x, _ = matrix(data)
    for i, model in enumerate((trees.ExtraTrees(4, depth=3).fit(rows), trees.Boosting(3).fit(rows))):
        model.save(spark, f"{tmp_path}/{i}")
        again = type(model).load(spark, f"{tmp_path}/{i}")
        assert np.array_equal(model.probabilities(x), again.probabilities(x)) and np.allclose(model.importances(), again.importances())


def test_no_rows_and_one_class(spark, rows):
    x = np.zeros((2, 4))
    for model in (trees.ExtraTrees(2), trees.Boosting(2)):
        assert np.allclose(model.fit(rows.limit(0)).probabilities(x), 1 / 3)
    for model in (trees.ExtraTrees(2), trees.Boosting(3)):
        assert (model.fit(rows.filter("y = 1")).probabilities(x).argmax(1) == 1).all()


def test_sampling_keeps_class_sums_within_one_row(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), r.choice([0.6, 1.4, 0.05, 2.3])) for i in range(1000)] + [(1000, "d", 0.4), (1001, None, 1.7), (1002, "a", None), (1003, "a", -2.0)]
    df = spark.createDataFrame(rows, "id int, y string, weight double").repartition(7)
    stored = {i: w or 0.0 for i, _, w in rows}
    got = models.systematic_sample(df)
    assert got.columns == df.columns
    times = {r.id: r.n for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()}
    for i, w in stored.items():
        assert math.floor(max(w, 0)) <= times.get(i, 0) <= math.ceil(max(w, 0))
    sums = {r.y: r.n for r in got.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y in ("a", "b", "c", "d", None):
        want = sum(max(w or 0, 0) for _, c, w in rows if c == y)
        assert abs(sums.get(y, 0) - want) < 1
    # 0.6 and 1.4 differ, which rounding to whole copies hides
    mean = lambda w: np.mean([times.get(i, 0) for i, x in stored.items() if x == w])
    assert abs(mean(0.6) - 0.6) < 0.1 and abs(mean(1.4) - 1.4) < 0.1


def test_sampling_is_exact_on_average_and_reproducible(spark):
    df = spark.createDataFrame([(i, "a", 0.3 + 0.1 * (i % 5)) for i in range(30)], "id int, y string, weight double").coalesce(1)
    seeds = range(10)
    total = dict.fromkeys(range(30), 0)
    for s in seeds:
        for r in models.systematic_sample(df, seed=s).collect():
            total[r.id] += 1
    assert all(abs(total[i] / len(seeds) - (0.3 + 0.1 * (i % 5))) < 0.6 for i in total)
    assert abs(sum(total.values()) / len(seeds) - 15) < 0.6
    assert sorted(models.systematic_sample(df, seed=1).collect()) == sorted(models.systematic_sample(df, seed=1).collect())


def test_network_stops_when_the_held_out_part_no_longer_gains(spark):
    r = random.Random(5)
    rows = [([r.gauss(0, 1), r.gauss(0, 1)], float(r.randrange(3))) for _ in range(200)]
    noise = spark.createDataFrame(rows, "x array<double>, _label double").select(array_to_vector("x").alias("features"), "_label", F.lit(1.0).alias("weight"))
    net = models.Network(hidden=(8,), iterations=300, stretch=10, patience=2)
    model = net.fit(noise)
    assert len(net.losses) < 30 and min(net.losses) < net.losses[-1] and model.numClasses == 3


@pytest.mark.parametrize("kind", ["forest", "extra", "boosting", "network"])
def test_candidates(spark, data, tmp_path, kind):
    data = data.withColumn("features", array_to_vector(F.transform("x", lambda v: F.nanvl(v, F.lit(0.0)))))
    one = models.Candidate(kind, trees=6).fit(models.weighted(data.select("features", "y")))
    got = one.predict(data).select("id", *models.PROBABILITIES).orderBy("id").collect()
    assert len(got) == 300 and all(abs(r.p_low + r.p_medium + r.p_high - 1) < 1e-9 for r in got)
    one.save(spark, str(tmp_path / kind))
    again = models.Candidate(kind, trees=6).load(spark, str(tmp_path / kind)).predict(data)
    assert again.select("id", *models.PROBABILITIES).orderBy("id").collect() == got
    assert len(one.importances(["a", "b", "c", "d"])) == 4
