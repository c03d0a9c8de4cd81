"""Queries of evaluation and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector

from tidemark.operators import evaluate, fit, models, stress
from tidemark.operators.asof import asof_reports
from tidemark.plans import training
from tidemark.queries.base import COMPONENTS, DataFrame, F, SparkSession, components, is_train, labelled, macro, panel, predictions, q, query, reports, rounded, shared_folder, sql, table
from tidemark.sources.shared import staged

_CALLED = ("called",)


def called(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).withColumn("pred", models.argmax(F.col("p_low"), F.col("p_medium"), F.col("p_high")))


_N = ", ".join(f"count(*) FILTER (y = '{a}' AND {{p}} = '{b}')::DOUBLE AS n{i}{j}" for i, a in enumerate(("low", "medium", "high")) for j, b in enumerate(("low", "medium", "high")))
_F1 = [f"coalesce(2 * n{i}{i} / nullif(n{i}0 + n{i}1 + n{i}2 + n0{i} + n1{i} + n2{i}, 0), 0)" for i in range(3)]
_T = [f"(n{i}0 + n{i}1 + n{i}2)" for i in range(3)]
_C = [f"(n0{i} + n1{i} + n2{i})" for i in range(3)]
_MACRO = f"({_F1[0]} + {_F1[1]} + {_F1[2]}) / 3"
_HIGH = f"n22 / greatest({_T[2]}, 1)"


@query(sql("SELECT t.truth, count(*) FILTER (pred = 'low') AS low, count(*) FILTER (pred = 'medium') AS medium, count(*) FILTER (pred = 'high') AS high FROM (VALUES ('low'), ('medium'), ('high')) t(truth) LEFT JOIN called c ON c.y = t.truth GROUP BY 1", *_CALLED))
def v1_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(called(spark, sf))


@query(sql(f"SELECT sector, {q(_MACRO, 6)} AS macro_f1, {q(f'({_F1[0]} * {_T[0]} + {_F1[1]} * {_T[1]} + {_F1[2]} * {_T[2]}) / ({_T[0]} + {_T[1]} + {_T[2]})', 6)} AS weighted_f1, {q(f'(coalesce(n00 / nullif({_T[0]}, 0), 0) + coalesce(n11 / nullif({_T[1]}, 0), 0) + coalesce(n22 / nullif({_T[2]}, 0), 0)) / (CAST({_T[0]} > 0 AS INT) + CAST({_T[1]} > 0 AS INT) + CAST({_T[2]} > 0 AS INT))', 6)} AS balanced_accuracy, {q(_HIGH, 6)} AS high_recall, {q(f'coalesce(n22 / nullif({_C[2]}, 0), 0)', 6)} AS high_precision, {q(f'1 - {_HIGH}', 6)} AS high_false_negative_rate, {q(f'(n00 + n01 + n10 + n11 + n12 + n21 + n22) / ({_T[0]} + {_T[1]} + {_T[2]})', 6)} AS adjacent_accuracy FROM (SELECT sector, {_N.format(p='pred')} FROM called GROUP BY 1)", *_CALLED))
def v2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """V2 to V5, by sector."""
    out = evaluate.classification_scores(called(spark, sf), by=["sector"])
    return rounded(out, {c: 6 for c in out.columns if c != "sector"})


@query(sql(f"SELECT {q('sum(abs(h - c)) / sum(n)', 6)} AS ece, {q('sum(c) / sum(n)', 6)} AS mean_confidence, {q('sum(p) / sum(n)', 6)} AS mean_p_high FROM (SELECT b, count(*)::DOUBLE AS n, sum(g) AS c, sum(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS h, sum(p_high) AS p FROM (SELECT *, greatest(p_low, p_medium, p_high) AS g, len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= greatest(p_low, p_medium, p_high))) AS b FROM called) GROUP BY b)", *_CALLED))
def v6_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.calibration(called(spark, sf)), {"ece": 6, "mean_confidence": 6, "mean_p_high": 6})


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS class, {q(f'coalesce(n{i}{i} / nullif({_C[i]}, 0), 0)', 6)} AS precision, {q(f'coalesce(n{i}{i} / nullif({_T[i]}, 0), 0)', 6)} AS recall, {q(_F1[i], 6)} AS f1, CAST({_T[i]} AS BIGINT) AS support FROM (SELECT {_N.format(p='pred')} FROM called)" for i, c in enumerate(("low", "medium", "high"))), *_CALLED))
def v7_classwise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.classwise(called(spark, sf)), {"precision": 6, "recall": 6, "f1": 6})


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS component, {q(f'''avg({c}) FILTER (pred = 'low')''', 5)} AS low, {q(f'''avg({c}) FILTER (pred = 'medium')''', 5)} AS medium, {q(f'''avg({c}) FILTER (pred = 'high')''', 5)} AS high, avg({c}) FILTER (pred = 'low') <= avg({c}) FILTER (pred = 'medium') + 1e-12 AND avg({c}) FILTER (pred = 'medium') <= avg({c}) FILTER (pred = 'high') + 1e-12 AS monotone FROM called" for c in ("p_high", "p_low")), *_CALLED))
def v8_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.monotonicity(called(spark, sf), ["p_high", "p_low"]), {"low": 5, "medium": 5, "high": 5})


# --- models ------------------------------------------------------------------------------------------


@query()
def m1_regimes(spark: SparkSession, sf: str) -> DataFrame:
    rows = macro(spark, sf)
    return models.Regimes(["key_rate", "fx_rate", "curve_slope", "market_vol_20d", "market_corr_60d"]).fit(rows).transform(rows).select("date", "regime")


@query()
def m2_latent_factors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    return models.LatentFactors([f"e{i}" for i in range(64)]).fit(vectors).transform(vectors).select("vec_id", "latent_0", "latent_1", "latent_2")


def _learn(spark: SparkSession, sf: str, kind: str, trees: int = 100) -> DataFrame:
    rows = table(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    y = F.when(F.col("label") < 3, "low").when(F.col("label") < 6, "medium").otherwise("high")
    named = rows.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), y.alias("y"))
    train = models.weighted(named.filter("vec_id % 4 <> 3"))
    return models.Candidate(kind, trees).fit(train).predict(named).select("vec_id", "y", "p_low", "p_medium", "p_high")


@query()
def m3_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _learn(spark, sf, "forest")


@query()
def m4_extra_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _learn(spark, sf, "extra")


@query()
def m5_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _learn(spark, sf, "boosting", 60)


@query()
def m6_network(spark: SparkSession, sf: str) -> DataFrame:
    return _learn(spark, sf, "network")


@query(sql(f"SELECT y, {q('(SELECT count(*) FROM pred) / (3.0::DOUBLE * count(*))', 6)} AS weight FROM pred GROUP BY 1", "pred"))
def m7_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.class_weights(predictions(spark, sf)), {"weight": 6})


@query("SELECT event_id, " + ", ".join(f"CASE WHEN a + b > 0 THEN {q(f'{e} / (a + b)', 6)} ELSE {q('1 / 3.0::DOUBLE', 6)} END AS {c}" for e, c in (("b", "p_low"), ("0.0", "p_medium"), ("a", "p_high"))) + " FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE abs(value) END::DOUBLE AS a, CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END::DOUBLE AS b FROM events)")
def m8_alignment(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.col("event_id") % 7 == 0
    raw = F.array(F.when(zero, 0.0).otherwise(F.abs("value")), F.when(zero, 0.0).otherwise(F.col("user_id").cast("double")))
    out = table(spark, sf, "events").select("event_id", raw.alias("v"))
    return rounded(out.withColumns(models.aligned(F.col("v"), ["high", "low"])), {c: 6 for c in models.PROBABILITIES}).select("event_id", *models.PROBABILITIES)


def _two(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidates' probabilities: the predictions, and the same with low and high exchanged."""
    names = {"a_p_low": "p_low", "a_p_medium": "p_medium", "a_p_high": "p_high", "b_p_low": "p_high", "b_p_medium": "p_medium", "b_p_high": "p_low"}
    return predictions(spark, sf).select("event_id", "y", *(F.col(v).alias(k) for k, v in names.items()))


_GRID10 = "grid AS (SELECT CAST(i AS INT) AS grid_id, i / 10.0::DOUBLE AS w, (10 - i) / 10.0::DOUBLE AS v FROM range(0, 11) g(i) UNION ALL SELECT 11, 1.0, 0.0 UNION ALL SELECT 12, 0.0, 1.0)"


@query(sql(f"SELECT grid_id, {q('w', 6)} AS w_a, {q(_MACRO, 6)} AS macro_f1, {q(_HIGH, 6)} AS high_recall FROM (SELECT grid_id, any_value(w) AS w, {_N.format(p='pred')} FROM (SELECT grid_id, w, y, CASE WHEN l >= m AND l >= h THEN 'low' WHEN m >= h THEN 'medium' ELSE 'high' END AS pred FROM (SELECT grid_id, w, y, w * p_low + v * p_high AS l, w * p_medium + v * p_medium AS m, w * p_high + v * p_low AS h FROM pred, grid)) GROUP BY 1)", "pred").replace(" SELECT grid_id, round", f", {_GRID10} SELECT grid_id, round", 1))
def m10_ensemble_search(spark: SparkSession, sf: str) -> DataFrame:
    out = models.ensemble_search(_two(spark, sf), ["a", "b"])
    return rounded(out, {"w_a": 6, "macro_f1": 6, "high_recall": 6}).select("grid_id", "w_a", "macro_f1", "high_recall")


@query(sql(f"SELECT event_id, {q('0.3 * p_low + 0.7 * p_high', 6)} AS p_low, {q('p_medium', 6)} AS p_medium, {q('0.3 * p_high + 0.7 * p_low', 6)} AS p_high FROM pred", "pred"))
def m11_soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    out = models.soft_vote_apply(_two(spark, sf), ["a", "b"], {"a": 0.3, "b": 0.7})
    return rounded(out, {c: 6 for c in models.PROBABILITIES}).select("event_id", *models.PROBABILITIES)


_GAMMA = "g AS (SELECT unnest([0.65, 0.80, 1.00, 1.25, 1.50, 1.80])::DOUBLE AS gamma)"
_POWERED = ", ".join(f"pow(least(greatest({p}, 1e-12), 1.0), gamma) AS {p[2]}" for p in ("p_low", "p_medium", "p_high"))


@query(sql(f"SELECT gamma, {q('''avg(-ln(greatest(CASE y WHEN 'low' THEN l WHEN 'medium' THEN m ELSE h END / (l + m + h), 1e-12)))''', 6)} AS log_loss FROM (SELECT gamma, y, {_POWERED} FROM pred, g) GROUP BY 1", "pred").replace(" SELECT gamma, round", f", {_GAMMA} SELECT gamma, round", 1))
def m12_calibration_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.calibration_search(predictions(spark, sf)), {"log_loss": 6}).select("gamma", "log_loss")


_CUT = "c AS (SELECT CAST(i AS INT) AS i, 0.25 + 0.025 * i AS v FROM range(0, 21) r(i)), grid AS (SELECT a.i * 21 + b.i AS grid_id, round(a.v, 3)::DOUBLE AS low_cut, round(b.v, 3)::DOUBLE AS high_cut FROM c a, c b)"
_POLICY = "CASE WHEN p_high >= high_cut THEN 'high' WHEN p_low >= low_cut AND pred <> 'high' THEN 'low' ELSE pred END"


@query(sql(f"SELECT CAST(grid_id AS INT) AS grid_id, {q(_MACRO, 6)} AS macro_f1, {q(_HIGH, 6)} AS high_recall FROM (SELECT grid_id, {_N.format(p='z')} FROM (SELECT grid_id, y, {_POLICY} AS z FROM called, grid) GROUP BY 1)", *_CALLED).replace(" SELECT CAST(grid_id", f", {_CUT} SELECT CAST(grid_id", 1))
def m13_policy_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.policy_search(predictions(spark, sf)), {"macro_f1": 6, "high_recall": 6}).select("grid_id", "macro_f1", "high_recall")


@query(sql(f"SELECT event_id, {_POLICY.replace('high_cut', '0.4').replace('low_cut', '0.55')} AS pred FROM called", *_CALLED))
def m14_policy(spark: SparkSession, sf: str) -> DataFrame:
    return models.apply_policy(predictions(spark, sf), 0.55, 0.40).select("event_id", "pred")


@query(sql(f"SELECT cut, {q('hit / nullif(t, 0)', 6)} AS recall, coalesce({q('hit / nullif(c, 0)', 6)}, {q('0', 6)}) AS precision, {q('2 * hit / (t + c)', 6)} AS f1, CAST(t - hit AS BIGINT) AS missed FROM (SELECT cut, count(*) FILTER (y = 'high' AND p_high >= cut)::DOUBLE AS hit, count(*) FILTER (p_high >= cut)::DOUBLE AS c, count(*) FILTER (y = 'high')::DOUBLE AS t FROM pred, (SELECT unnest([0.45, 0.40, 0.35, 0.30, 0.25, 0.20])::DOUBLE AS cut) GROUP BY 1)", "pred"))
def m15_threshold_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.threshold_table(predictions(spark, sf)), {"recall": 6, "precision": 6, "f1": 6})


def _overlay(spark: SparkSession, sf: str) -> DataFrame:
    return called(spark, sf).withColumn("global_pred", F.col("pred")).withColumn("expert_pred", F.when(F.col("sector") == "S2", F.col("y")).otherwise(F.lit("medium")))


_OVER = f"SELECT sector, count(*) AS n, {_N.format(p='pred')}, {_N.format(p='x').replace(' AS n', ' AS e')} FROM (SELECT *, CASE WHEN sector = 'S2' THEN y ELSE 'medium' END AS x FROM called) GROUP BY 1"


def _e(x: str) -> str:
    import re

    return re.sub(r"\bn(\d\d)\b", r"e\1", x)


@query(sql(f"SELECT sector, n, {q(_MACRO, 6)} AS global_macro_f1, {q(_e(_MACRO), 6)} AS expert_macro_f1, {q(f'{_e(_MACRO)} - {_MACRO}', 6)} AS gain, n >= 18 AND {_e(_MACRO)} - {_MACRO} >= 0.1 AS selected FROM ({_OVER})", *_CALLED))
def m16_sector_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.sector_overlay(_overlay(spark, sf)), {"global_macro_f1": 6, "expert_macro_f1": 6, "gain": 6})


@query(sql("SELECT event_id, CASE WHEN sector = 'S2' THEN y ELSE pred END AS pred, sector = 'S2' AS used_sector_expert FROM called", *_CALLED))
def m17_apply_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = _overlay(spark, sf)
    return models.apply_overlay(rows.drop("pred"), models.sector_overlay(rows)).select("event_id", "pred", "used_sector_expert")


@query(sql(f"SELECT metric, {q('b', 6)} AS baseline, {q('e', 6)} AS enhanced, {q('e - b', 6)} AS delta FROM (SELECT 'macro_f1' AS metric, {_MACRO} AS b, {_e(_MACRO)} AS e FROM (SELECT {_N.format(p='pred')}, {_N.format(p='x').replace(' AS n', ' AS e')} FROM (SELECT *, CASE WHEN sector = 'S2' THEN y ELSE 'medium' END AS x FROM called)) UNION ALL SELECT 'high_recall', {_HIGH}, {_e(_HIGH)} FROM (SELECT {_N.format(p='pred')}, {_N.format(p='x').replace(' AS n', ' AS e')} FROM (SELECT *, CASE WHEN sector = 'S2' THEN y ELSE 'medium' END AS x FROM called)))", *_CALLED))
def m24_metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = _overlay(spark, sf)
    pick = lambda p: evaluate.classification_scores(rows, pred=p).select("macro_f1", "high_recall")
    return rounded(evaluate.metric_delta(pick("global_pred"), pick("expert_pred")), {"baseline": 6, "enhanced": 6, "delta": 6})


_NUMERIC = ["rolling_vol_20d", "downside_vol_60d", "beta_60d", "log_market_cap", "momentum_6m", "key_rate", "fx_rate"]
_STRESSED = ["report_financial_pressure", "report_sanctions_flag", "report_liquidity_refinancing_flag", "report_covenant_flag"]


def _stressed(spark: SparkSession, sf: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The components beside the report columns known at their date."""
    flags = {f"report_{name}_flag": (F.col("doc_id") % n == 0).cast("double") for name, n in (("sanctions", 6), ("liquidity_refinancing", 4), ("covenant", 3))}
    return asof_reports(components(spark, sf), reports(spark, sf).withColumns(flags), [*_STRESSED, *also], tie=["doc_id"])


_STRESS_SQL = (
    "SELECT ticker, decision_date, " + ", ".join(f"{q(f'{c} * (1 + 0.22 * k)', 6)} AS {c}" for c in COMPONENTS) + f", {q('k', 6)} AS stress_rank FROM ("
    "SELECT *, (rank() OVER (PARTITION BY date_trunc('month', decision_date) ORDER BY s) + (count(*) OVER (PARTITION BY date_trunc('month', decision_date), s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date_trunc('month', decision_date)) AS k FROM ("
    "SELECT *, coalesce(p, 0) + 0.10::DOUBLE * coalesce(a, 0) + 0.08::DOUBLE * coalesce(b, 0) + 0.06::DOUBLE * coalesce(c, 0) AS s FROM stressed))"
)


@query(sql(_STRESS_SQL, "stressed"))
def m24_stress_panel(spark: SparkSession, sf: str) -> DataFrame:
    out = stress.stress_adjusted(_stressed(spark, sf))
    return rounded(out, {c: 6 for c in (*COMPONENTS, "stress_rank")}).select("ticker", "decision_date", *COMPONENTS, "stress_rank")


@query()
def m24_report_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas of two runs on the stress-adjusted labels, without and with the report columns."""
    adjusted = stress.stress_adjusted(staged(_stressed(spark, sf, ("report_text_risk_density", "report_free_cf_margin")), "stressed"))
    rows = fit.prepare_targets(adjusted, is_train()).join(panel(spark, sf), ["ticker", "decision_date"])
    return training.report_ablation(staged(rows, "ablation"), _NUMERIC, _MACRO_SERIES, [*_STRESSED, "report_text_risk_density", "report_free_cf_margin"])


_REPORT = ["report_net_debt_to_ebitda", "report_interest_coverage", "report_free_cf_margin", "report_financial_pressure", "report_text_risk_density"]
_MACRO_SERIES = ["key_rate", "fx_rate", "curve_slope", "market_vol_20d", "market_corr_60d"]


def _data(spark: SparkSession, sf: str, with_reports: bool = False) -> DataFrame:
    """The labelled panel, stored, as the fits read it many times."""
    keys = labelled(spark, sf).select("ticker", "decision_date", "risk_class", "future_max_drawdown", "future_cvar_95")
    rows = panel(spark, sf).join(keys, ["ticker", "decision_date"])
    return staged(asof_reports(rows, reports(spark, sf), _REPORT, tie=["doc_id"]) if with_reports else rows, "panel")


@query()
def m9_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return training.fit_bundle(training.with_split(_data(spark, sf)), _NUMERIC, ["sector"], ("forest", "extra", "boosting"), trees=60).leaderboard(spark)


@query()
def m20_importances(spark: SparkSession, sf: str) -> DataFrame:
    return training.fit_bundle(training.with_split(_data(spark, sf)), _NUMERIC, ["sector"], ("forest",), trees=60).importances(spark)


@query()
def m21_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation of the scores over all folds of three months."""
    return training.walk_forward_summary(training.walk_forward_scores(_data(spark, sf), _NUMERIC, _MACRO_SERIES))


@query()
def m22_batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """M22, M23: a run's package is saved, loaded, and scores all rows of the panel."""
    path, rows = shared_folder(spark, "package"), _data(spark, sf, True)
    training.run(rows, _NUMERIC, _MACRO_SERIES, _REPORT).package.save(spark, path)
    return training.Package.load(spark, path).score(rows).select("decision_date", "ticker", "regime", "pred", *models.PROBABILITIES, "used_sector_expert")


@query()
def m25_training_run(spark: SparkSession, sf: str) -> DataFrame:
    """M18, M19 and M25: fits the architectures, lets reports in if they gain, chooses one, and scores the test period."""
    return training.run(_data(spark, sf, True), _NUMERIC, _MACRO_SERIES, _REPORT).predictions
