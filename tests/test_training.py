"""The training run on a small panel: its package, saved and loaded, scores as the run did; the paired run; the walk."""

import math
import os
import random
from datetime import date

import pytest

from tidemark.plans import training
from tidemark.plans.training import MISSING, fold_preprocessors, walk_forward_scores, walk_forward_summary

RANGES = {"train": ("2020-01-01", "2020-12-31"), "validation": ("2021-01-01", "2021-06-30"), "test": ("2021-07-01", "2021-12-31")}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for m in range(24):
        for t in range(14):
            x = r.gauss(0, 1)
            y = ("low", "medium", "high")[(x + r.gauss(0, 0.3) > -0.4) + (x + r.gauss(0, 0.3) > 0.4)]
            out.append((date(2020 + m // 12, m % 12 + 1, 28), f"T{t}", r.choice(["S1", "S2", None]), y, x, r.gauss(0, 1) if r.random() < 0.9 else None, float(m % 5), r.random(), x / 2 + r.gauss(0, 0.1)))
    df = spark.createDataFrame(out, "decision_date date, ticker string, sector string, risk_class string, a double, b double, rate double, vol double, report_pressure double")
    return df.repartition(3).persist()


def test_package_scores_as_the_run_did(spark, rows, tmp_path):
    run = training.run(rows, ["a", "b", "vol"], ["rate", "vol"], ["report_pressure"], ranges=RANGES, trees=6, kinds=("forest", "extra"), weight_step=0.5)
    run.package.save(spark, f"{tmp_path}/package")
    again = training.Package.load(spark, f"{tmp_path}/package")
    names = ["decision_date", "ticker", "pred", "used_sector_expert", "p_low", "p_medium", "p_high"]
    want = {(r.decision_date, r.ticker): r for r in run.predictions.select(names).collect()}
    got = [r for r in again.score(rows).select(names).collect() if (r.decision_date, r.ticker) in want]
    assert len(got) == len(want) == 6 * 14
    for r in got:
        w = want[r.decision_date, r.ticker]
        assert r.pred == w.pred and r.used_sector_expert == w.used_sector_expert
        assert all(math.isclose(r[c], w[c], abs_tol=1e-12) for c in names[4:]) and math.isclose(r.p_low + r.p_medium + r.p_high, 1, abs_tol=1e-9)
    right = run.predictions.filter("y = pred").count() / len(want)
    assert right > 0.5 and {r.architecture for r in run.scores.collect()} >= {"baseline", "regime", "factors", "factors_regime"}


@pytest.mark.skipif(not os.environ.get("ALL_QUERIES"), reason="ten fits")
def test_paired_run(spark, rows):
    delta = {r.metric: r for r in training.report_ablation(rows, ["b", "vol", "rate"], ["rate"], ["report_pressure"], ranges=RANGES, trees=4, kinds=("forest",)).collect()}
    assert set(delta) == {"macro_f1", "weighted_f1", "accuracy", "high_recall", "high_precision"}
    assert all(math.isclose(r.delta, r.enhanced - r.baseline, abs_tol=1e-12) for r in delta.values()) and delta["accuracy"].enhanced > delta["accuracy"].baseline


def test_walk(spark, rows):
    scores = walk_forward_scores(rows, ["a", "b"], ["rate", "vol"], initial=12, test=3, step=3, trees=4, kinds=("extra",), starts=3, weight_step=0.5).orderBy("fold").collect()
    assert [r.fold for r in scores] == [1, 2, 3, 4] and all(r.macro_f1 > 0.4 for r in scores)
    summary = {r.metric: r for r in walk_forward_summary(spark.createDataFrame(scores)).collect()}
    assert summary["macro_f1"].folds == 4


def test_categories_grow_with_the_folds(spark):
    df = spark.createDataFrame([("A", 1, 1.0), (None, 2, 2.0), ("B", 3, 3.0), ("C", None, 4.0)], "s string, e int, x double")
    assert [p.values["s"] for p in fold_preprocessors(df, ["x"], ["s"], 3, "e")] == [["A"], ["A", MISSING], ["A", "B", MISSING]]
    assert [p.medians["x"] for p in fold_preprocessors(df, ["x"], ["s"], 3, "e")] == [1.0, 1.5, 2.0]
