"""The training run: split, regimes, candidates, ensemble, calibration, policy, overlay, choice, scoring, and the
package that keeps all of it for scoring later."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import finite
from tidemark.operators import models, splits
from tidemark.operators.clusters import kmeans_folds, regime
from tidemark.operators.evaluate import classification_scores, metric_delta
from tidemark.operators.fit import CLASSES, MISSING, Preprocessor
from tidemark.operators.selection import FoldStatistics
from tidemark.sources.shared import staged

DEFAULT_RANGES = {"train": ("1996-01-01", "1999-06-30"), "validation": ("1999-07-01", "2000-03-31"), "test": ("2000-04-01", "2000-12-31")}


def with_split(df: DataFrame, ranges: Mapping[str, tuple[str, str]] = DEFAULT_RANGES, embargo_days: int = 0) -> DataFrame:
    """The rows of the splits, with y for the class."""
    return splits.temporal_split(df, ranges, embargo_days=embargo_days).withColumn("y", F.col("risk_class"))


@dataclass
class Bundle:
    """Fitted candidates with their weights, power and cuts; everything needed to score."""

    preprocessor: Preprocessor
    features: list[str]
    candidates: dict[str, models.Candidate]
    weights: dict[str, float] = field(default_factory=dict)
    gamma: float = 1.0
    cuts: tuple[float, float] = (0.5, 0.45)
    rows: list[tuple] = field(default_factory=list)

    def vectors(self, df: DataFrame) -> DataFrame:
        out = self.preprocessor.outputs()
        names = [f"_f{i}" for i in range(len(out))]
        wide = df.select("*", *(c.alias(n) for n, c in zip(names, out.values())))
        return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)

    def votes(self, df: DataFrame) -> DataFrame:
        out = self.vectors(df)
        for name, c in self.candidates.items():
            out = c.predict(out).withColumnsRenamed({p: f"{name}_{p}" for p in models.PROBABILITIES})
        return out.drop("features")

    def score(self, df: DataFrame) -> DataFrame:
        """df with p_low, p_medium, p_high and pred."""
        names = list(self.candidates)
        out = models.soft_vote_apply(self.votes(df), names, self.weights)
        out = models.apply_policy(models.calibrate(out, self.gamma), *self.cuts)
        return out.drop(*(f"{n}_{p}" for n in names for p in models.PROBABILITIES))

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, macro_f1 double, high_recall double, objective double")

    def importances(self, spark: SparkSession) -> DataFrame:
        """Importances of the candidates by their ensemble weights, the 20 largest."""
        rows = [(n, float(i), float(self.weights[k])) for k, c in self.candidates.items() for n, i in c.importances(self.features)]
        table = spark.createDataFrame(rows, "feature string, importance double, weight double")
        return table.groupBy("feature").agg(F.sum(F.col("importance") * F.col("weight")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(20)

    def state(self) -> dict:
        return {"preprocessor": self.preprocessor.state(), "features": self.features, "kinds": {k: c.trees for k, c in self.candidates.items()}, "weights": self.weights, "gamma": self.gamma, "cuts": list(self.cuts), "rows": [list(r) for r in self.rows]}

    def save(self, spark: SparkSession, path: str) -> None:
        for kind, c in self.candidates.items():
            c.save(spark, f"{path}/{kind}")

    @staticmethod
    def load(spark: SparkSession, state: dict, path: str) -> Bundle:
        candidates = {k: models.Candidate(k, trees).load(spark, f"{path}/{k}") for k, trees in state["kinds"].items()}
        return Bundle(Preprocessor.from_state(state["preprocessor"]), state["features"], candidates, state["weights"], state["gamma"], tuple(state["cuts"]), [tuple(r) for r in state["rows"]])


def fit_bundle(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), kinds: Sequence[str] = ("forest", "extra", "boosting"), trees: int = 60, weight_step: float = 0.10, bonus: float = 0.02, seed: int = 7, preprocessor: Preprocessor | None = None, weight: Column | None = None) -> Bundle:
    """rows: split and y, stored or cheap to make.  Candidates learn from train; weights, power and cuts are chosen on validation.

    preprocessor and weight: fitted ones, where they are known already.
    """
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    pre = Preprocessor(list(numeric), list(categorical)).fit(train) if preprocessor is None else preprocessor
    bundle = Bundle(pre, list(pre.outputs()), {})
    learn = (models.weighted(bundle.vectors(train)) if weight is None else bundle.vectors(train).withColumn("weight", weight)).persist()
    try:
        # independent fits of many small jobs
        fit = inheritable_thread_target(rows.sparkSession)(lambda k: models.Candidate(k, trees, seed).fit(learn))
        with ThreadPool(len(kinds)) as pool:
            bundle.candidates = dict(zip(kinds, pool.map(fit, kinds)))
    finally:
        learn.unpersist()
    # the searches only need the class and the votes
    votes = bundle.votes(validation).select("y", *(f"{k}_{p}" for k in kinds for p in models.PROBABILITIES)).persist()
    try:
        for k in kinds:
            pred = models.argmax(*(F.col(f"{k}_{p}") for p in models.PROBABILITIES))
            s = classification_scores(votes.withColumn("pred", pred)).first()
            bundle.rows.append((k, s["macro_f1"] or 0.0, s["high_recall"], (s["macro_f1"] or 0.0) + bonus * s["high_recall"]))
        best = models.ensemble_search(votes, list(kinds), weight_step, bonus).first()
        bundle.weights = {k: best[f"w_{k}"] if best else 1 / len(kinds) for k in kinds}
        voted = models.soft_vote_apply(votes, list(kinds), bundle.weights)
        power = models.calibration_search(voted).first()
        bundle.gamma = power["gamma"] if power else 1.0
        cut = models.policy_search(models.calibrate(voted, bundle.gamma), bonus=bonus).first()
    finally:
        votes.unpersist()
    if cut:
        bundle.cuts = (cut["low_cut"], cut["high_cut"])
        bundle.rows += [("ensemble", best["macro_f1"], best["high_recall"], best["objective"]), ("policy", cut["macro_f1"], cut["high_recall"], cut["objective"])]
    bundle.rows.sort(key=lambda r: (-r[3], r[0]))
    return bundle


@dataclass
class Package:
    """All that scoring needs: regimes, factors, the chosen architecture, the regime expert and its sectors."""

    regimes: models.Regimes
    factors: models.LatentFactors
    chosen: str
    bundle: Bundle
    expert: Bundle
    sectors: list[str]
    sector: str = "sector"

    def score(self, df: DataFrame) -> DataFrame:
        """df with regime, factors, p_low, p_medium, p_high, pred and used_sector_expert."""
        names = [*models.PROBABILITIES, "pred"]
        out = self.factors.transform(self.regimes.transform(df))
        out = self.bundle.score(out).withColumnsRenamed({n: f"_global_{n}" for n in names})
        out = self.expert.score(out).withColumnsRenamed({n: f"_expert_{n}" for n in names})
        out = out.withColumn("used_sector_expert", F.coalesce(F.col(self.sector).isin(self.sectors), F.lit(False)))
        picked = {n: F.when(F.col("used_sector_expert"), F.col(f"_expert_{n}")).otherwise(F.col(f"_global_{n}")) for n in names}
        return out.withColumns(picked).drop(*(f"_{side}_{n}" for side in ("global", "expert") for n in names))

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder: the fitted models, and the parameters as a text of one row."""
        self.regimes.save(f"{path}/regimes")
        self.factors.save(f"{path}/factors")
        self.bundle.save(spark, f"{path}/bundle")
        self.expert.save(spark, f"{path}/expert")
        state = {"regimes": self.regimes.state(), "factors": self.factors.state(), "chosen": self.chosen, "bundle": self.bundle.state(), "expert": self.expert.state(), "sectors": self.sectors, "sector": self.sector}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Package:
        s = json.loads(spark.read.text(f"{path}/state").first()["value"])
        return Package(
            models.Regimes.load(s["regimes"], f"{path}/regimes"), models.LatentFactors.load(s["factors"], f"{path}/factors"), s["chosen"],
            Bundle.load(spark, s["bundle"], f"{path}/bundle"), Bundle.load(spark, s["expert"], f"{path}/expert"), s["sectors"], s["sector"],
        )


@dataclass
class Run:
    chosen: str
    scores: DataFrame
    predictions: DataFrame
    overlay: DataFrame
    package: Package


def run(df: DataFrame, numeric: Sequence[str], macro: Sequence[str], report: Sequence[str] = (), sector: str = "sector", ranges: Mapping[str, tuple[str, str]] = DEFAULT_RANGES, trees: int = 60, kinds: Sequence[str] = ("forest", "extra", "boosting"), report_gain: float = 0.005, embargo_days: int = 0, weight_step: float = 0.10) -> Run:
    """Fits the architectures, lets reports in if they gain, adds regimes, factors and the sector overlay, and scores.

    Architectures: baseline, with reports, with regimes, with factors, with both.  The one with the best (objective,
    macro F1, high recall) on validation wins, the first of equals; reports enter all later ones if they gain.
    """
    spark = df.sparkSession
    rows = staged(with_split(df, ranges, embargo_days), "rows")
    train = rows.filter("split = 'train'")
    regimes = models.Regimes(list(macro)).fit(train)
    factors = models.LatentFactors(list(numeric)).fit(train)
    rich = staged(factors.transform(regimes.transform(rows)), "rich")
    latent = ["latent_0", "latent_1", "latent_2"]
    fit = inheritable_thread_target(spark)(lambda plan: fit_bundle(rich, *plan, kinds, trees, weight_step))

    def fitted(plans: dict[str, tuple[list[str], list[str]]]) -> dict[str, Bundle]:
        """Independent fits of many small jobs, side by side."""
        with ThreadPool(len(plans)) as pool:
            return dict(zip(plans, pool.map(fit, plans.values())))

    bundles = fitted({"baseline": ([*numeric], [sector])} | ({"reports": ([*numeric, *report], [sector])} if report else {}))
    if report:
        if bundles["reports"].rows[0][3] >= bundles["baseline"].rows[0][3] + report_gain:
            numeric = [*numeric, *report]
        else:
            del bundles["reports"]
    bundles |= fitted({"regime": ([*numeric], [sector, "regime"]), "factors": ([*numeric, *latent], [sector]), "factors_regime": ([*numeric, *latent], [sector, "regime"])})
    results = [(name, *b.rows[0][1:]) for name, b in bundles.items()]
    chosen = max(results, key=lambda r: (r[3], r[1], r[2]))[0]

    def validated(bundle: Bundle, name: str, df: DataFrame) -> DataFrame:
        return bundle.score(df).withColumnRenamed("pred", name).drop(*models.PROBABILITIES)

    both = validated(bundles["regime"], "expert_pred", validated(bundles[chosen], "global_pred", rich.filter("split = 'validation'")))
    overlay = staged(models.sector_overlay(both.withColumnRenamed(sector, "sector")), "overlay")
    # as many rows as there are sectors
    sectors = sorted(r["sector"] for r in overlay.filter("selected and sector is not null").collect())
    package = Package(regimes, factors, chosen, bundles[chosen], bundles["regime"], sectors, sector)
    out = package.score(rows.filter("split = 'test'")).select("decision_date", "ticker", F.col(sector).alias("sector"), "y", "pred", *models.PROBABILITIES, "used_sector_expert")
    return Run(chosen, spark.createDataFrame(results, "architecture string, macro_f1 double, high_recall double, objective double"), out, overlay, package)


def report_ablation(df: DataFrame, numeric: Sequence[str], macro: Sequence[str], report: Sequence[str], ranges: Mapping[str, tuple[str, str]] = DEFAULT_RANGES, trees: int = 24, kinds: Sequence[str] = ("forest", "extra"), metrics: Sequence[str] = ("macro_f1", "weighted_f1", "accuracy", "high_recall", "high_precision")) -> DataFrame:
    """metric, baseline, enhanced and delta of two runs on the same rows and labels, without and with the report columns."""
    scores = []
    for names in ((), report):
        one = run(df, numeric, macro, names, ranges=ranges, trees=trees, kinds=kinds, weight_step=0.25)
        accuracy = one.predictions.agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))  # one row
        scores.append(staged(classification_scores(one.predictions).crossJoin(F.broadcast(accuracy)).select(*metrics), "ablation"))
    return metric_delta(*scores)


def fold_preprocessors(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int, entry: str = "_entry") -> list[Preprocessor]:
    """The preprocessor of each fold's train rows (those that enter by it), without a pass per fold."""
    found = FoldStatistics(rows, numeric, F.col(entry), folds)
    first = {c: rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")).agg(F.min(entry).alias("e")).filter("e is not null").collect() for c in categorical}
    out = []
    for fold in range(1, folds + 1):
        pre = Preprocessor(list(numeric), list(categorical))
        at = lambda values, default: {c: values.get((c, fold), default) for c in numeric}  # noqa: B023, E731
        pre.medians, pre.bounds, pre.means, scales = at(found.medians, 0.0), at(found.bounds, (0.0, 0.0)), at(found.means, 0.0), at(found.scales, 1.0)
        pre.scales = {c: v or 1.0 for c, v in scales.items()}
        pre.values = {c: sorted(r["v"] for r in first[c] if r["e"] <= fold) for c in categorical}
        out.append(pre)
    return out


def fold_regimes(rows: DataFrame, macro: Sequence[str], folds: int, starts: int = 16, k: int = 2, entry: str = "_entry") -> list[Column]:
    """The regime of a row by each fold's train rows: all folds and starts are clustered in the same passes."""
    found = FoldStatistics(rows, macro, F.col(entry), folds)
    medians = [[found.medians.get((c, f), 0.0) for c in macro] for f in range(1, folds + 1)]
    scales = [tuple(zip(*(found.filled_moments(c, f) for c in macro))) for f in range(1, folds + 1)]
    # a null's stand-in differs by fold, so it is left out of the rows and filled in the passes' own scale: at the median
    filled = rows.filter(F.col(entry).isNotNull()).select(F.array(*(F.coalesce(finite(F.col(c)), F.lit(float("nan"))) for c in macro)).alias("x"), F.col(entry).cast("int").alias("e"), F.monotonically_increasing_id().alias("key"))
    centres = kmeans_folds(staged(filled, "regimes"), scales, k, starts, medians=medians)
    return [regime(macro, m, s, c) for m, s, c in zip(medians, scales, centres)]


def folds_entered(folds: DataFrame, gated: Sequence[int]) -> DataFrame:
    """Per month: ``_entry``, the number (from 1) of the first gated fold that trains on it, and the folds that validate and test on it."""
    known = folds.filter(F.col("fold").isin(list(gated)))
    number = F.array_position(F.array(*(F.lit(int(g)) for g in gated)), F.col("fold")).cast("int")
    of = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("fold")))).alias(f"_{role}")
    return known.groupBy("month").agg(F.min(F.when(F.col("role") == "train", number)).alias("_entry"), of("validation"), of("test"))


def walk_forward_scores(
    df: DataFrame, numeric: Sequence[str], macro: Sequence[str] = (), initial: int = 12, test: int = 3, step: int = 3, trees: int = 250, kinds: Sequence[str] = ("forest", "extra"), starts: int = 16, weight_step: float = 0.20, parallel: int = 8
) -> DataFrame:
    """One row of scores for each fold that passes the gate: regimes, forest and extra trees are fitted anew in each.

    Train parts grow, so a row is told by the fold at which it enters; medians, bounds, scales, categories and class
    weights of all folds come from statistics by that fold, and their regimes from shared passes.  Folds differ in
    their fits only, some of which run at a time; they are as many as there are steps of months.
    """
    spark = df.sparkSession
    rows = staged(df.withColumn("y", F.col("risk_class")).withColumn("_month", F.trunc("decision_date", "month")), "walk")
    folds = splits.walk_forward(rows, initial, test, step)
    gated = [g["fold"] for g in splits.fold_gate(splits.with_folds(rows, folds)).filter("ok").orderBy("fold").collect()]
    if not gated:
        return spark.createDataFrame([], "fold int, macro_f1 double")
    # as many rows as months
    rows = rows.join(F.broadcast(folds_entered(folds, gated)), rows["_month"] == F.col("month"), "left").drop("month", "_month")
    rows = staged(rows, "walk-entry")
    pres = fold_preprocessors(rows, numeric, ["sector"], len(gated))
    regimes = fold_regimes(rows, macro, len(gated), starts) if macro else [None] * len(gated)
    counts = {(r["_entry"], r["y"]): r["n"] for r in rows.filter("_entry is not null").groupBy("_entry", "y").agg(F.count("*").alias("n")).collect()}

    def one(i: int) -> tuple:
        fold = gated[i]
        role = F.when(F.col("_entry") <= i + 1, "train").when(F.array_contains("_validation", fold), "validation").when(F.array_contains("_test", fold), "test")
        part, pre = rows.withColumn("split", role).filter("split is not null"), pres[i]
        if macro:
            part = part.withColumn("regime", regimes[i])
            pre.categorical.append("regime")
            pre.values["regime"] = [f"regime_{n}" for n in range(2)]
        sizes = {y: sum(n for (e, label), n in counts.items() if label == y and e <= i + 1) for y in CLASSES}
        total, present = sum(sizes.values()), sum(n > 0 for n in sizes.values())
        weight = F.lit(None).cast("double")
        for y, n in sizes.items():
            weight = F.when(F.col("y") == y, total / (present * max(n, 1))).otherwise(weight)
        bundle = fit_bundle(part, numeric, pre.categorical, kinds, trees, weight_step=weight_step, seed=7 + fold, preprocessor=pre, weight=weight)
        scored = classification_scores(bundle.score(part.filter("split = 'test'")))
        return scored.columns, tuple(scored.first())

    with ThreadPool(max(1, min(parallel, len(gated)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(one), range(len(gated)))
    return spark.createDataFrame([(int(f), *r) for f, (_, r) in zip(gated, found)], ["fold", *found[0][0]])


def walk_forward_summary(scores: DataFrame, metrics: Sequence[str] = ("macro_f1", "high_recall")) -> DataFrame:
    """metric, folds, mean and population deviation over the folds."""
    long = scores.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
