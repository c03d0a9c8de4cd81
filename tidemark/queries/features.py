"""Queries of ratios, targets, derived features, splits, quality, drift and preprocessing."""

from __future__ import annotations

from tidemark.functions import features as feat
from tidemark.operators import fit, quality, splits
from tidemark.queries.base import (
    COMPONENTS, DataFrame, F, RANGES, SparkSession, asof_join, components, fundamentals, is_train, keys, labelled, panel, q, query, r, reports, rounded, snapshot, sql,
)

# --- fundamentals ------------------------------------------------------------------------------------
_RATIOS = {"net_debt_to_ebitda": 3, "interest_coverage": 3, "ebitda_margin": 5, "book_to_market": 6}
_FLAGS = ("net_debt_to_ebitda_missing", "interest_coverage_missing", "cash_flow_missing")
_FUNDED = sql(
    "SELECT s.ticker, s.decision_date, "
    + q("f.net_debt / nullif(f.ebitda, 0)", 3) + " AS net_debt_to_ebitda, " + q("f.ebitda / nullif(abs(f.interest_expense), 0)", 3) + " AS interest_coverage, "
    + q("f.ebitda / nullif(f.revenue, 0)", 5) + " AS ebitda_margin, " + q("f.book_equity / nullif(s.market_cap, 0)", 6) + " AS book_to_market, "
    + "CAST(f.net_debt IS NULL OR f.ebitda IS NULL AS INT) AS net_debt_to_ebitda_missing, CAST(f.ebitda IS NULL OR f.interest_expense IS NULL AS INT) AS interest_coverage_missing, CAST(f.operating_cash_flow IS NULL OR f.free_cash_flow IS NULL AS INT) AS cash_flow_missing "
    "FROM snap s ASOF LEFT JOIN fund f ON s.ticker = f.ticker AND s.decision_date >= f.publish_date",
    "snap", "fund",
)


def funded(spark: SparkSession, sf: str) -> DataFrame:
    named = {c: f"fund_{c}" for c in feat.FUNDAMENTALS}
    return feat.fundamental_ratios(asof_join(snapshot(spark, sf), fundamentals(spark, sf), "ticker", "decision_date", "publish_date", named, tie="report_date"), "fund_")


@query(_FUNDED)
def d_fundamental_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """D1 to D5."""
    return rounded(funded(spark, sf), _RATIOS).select("ticker", "decision_date", *_RATIOS, *_FLAGS)


# --- targets -----------------------------------------------------------------------------------------


@query(sql("SELECT ticker, decision_date, " + ", ".join(f"{q(c + '_rank', 6)} AS {c}_rank" for c in COMPONENTS) + f", {q('risk_score', 6)} AS risk_score FROM score", "score"))
def t6_ecdf_score(spark: SparkSession, sf: str) -> DataFrame:
    """T6 and T7."""
    df = components(spark, sf).persist()
    scored = fit.risk_score(fit.ecdf_rank(df, df.filter(is_train()), list(COMPONENTS)))
    return rounded(scored, {f"{c}_rank": 6 for c in COMPONENTS} | {"risk_score": 6}).select("ticker", "decision_date", *(f"{c}_rank" for c in COMPONENTS), "risk_score")


@query(sql(f"SELECT {q('t[1]', 6)} AS low_cut, {q('t[2]', 6)} AS high_cut FROM thirds", "thirds"))
def t8_terciles(spark: SparkSession, sf: str) -> DataFrame:
    df = components(spark, sf).persist()
    scored = fit.risk_score(fit.ecdf_rank(df, df.filter(is_train()), list(COMPONENTS)))
    low, high = fit.terciles(scored.filter(is_train()))
    return spark.createDataFrame([(low, high)], "low_cut double, high_cut double").select(r("low_cut", 6).alias("low_cut"), r("high_cut", 6).alias("high_cut"))


@query(sql("SELECT ticker, decision_date, risk_class FROM labelled", "labelled"))
def t10_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T9 and T10."""
    return labelled(spark, sf).select("ticker", "decision_date", "risk_class")


@query(sql("SELECT c.risk_class, count(l.risk_class) AS n FROM (VALUES ('low'), ('medium'), ('high')) c(risk_class) LEFT JOIN labelled l ON l.risk_class = c.risk_class GROUP BY 1", "labelled"))
def t11_class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return fit.class_distribution(labelled(spark, sf))


# --- derived features --------------------------------------------------------------------------------
_DERIVED = {
    "downside_to_total_vol": (6, "coalesce(downside_vol_60d / nullif(rolling_vol_20d + 1e-12, 0), 0)"),
    "liquidity_stress": (5, "ls"),
    "liquidity_vol_interaction": (5, "ls * rolling_vol_20d"),
    "beta_vol_interaction": (5, "beta_60d * rolling_vol_20d"),
    "macro_pressure": (5, "0.05 * key_rate + 10.0 * market_vol_20d + 0.50 * market_corr_60d - 0.10 * curve_slope"),
    "rate_fx_pressure": (5, "key_rate * ln(1 + CASE WHEN fx_rate IS NOT NULL THEN greatest(fx_rate, 0) END)"),
    "debt_service_stress": (5, "ds"),
    "cashflow_buffer": (2, "cb"),
    "size_liquidity_interaction": (4, "log_market_cap * ln(1 + avg_daily_traded_value_20d)"),
    "momentum_reversal_risk": (5, "CASE WHEN momentum_6m IS NOT NULL THEN greatest(-momentum_6m, 0) END * (1 + CASE WHEN beta_60d IS NOT NULL THEN greatest(beta_60d, 0) END)"),
    "fundamental_fragility": (2, "ds - cb"),
    "report_leverage_pressure": (5, "lp"),
    "report_cashflow_pressure": (5, "cp"),
    "report_staleness_weight": (6, "sw"),
    "report_integrated_stress": (5, "(0.45 * greatest(report_financial_pressure, 0) + 0.30 * lp + 0.25 * cp) * coalesce(sw, 0)"),
    "fundamental_report_gap": (2, "ds - cb - (0.45 * greatest(report_financial_pressure, 0) + 0.30 * lp + 0.25 * cp) * coalesce(sw, 0)"),
}
_REPORTED = ("report_financial_pressure", "report_net_debt_to_ebitda", "report_interest_coverage", "report_free_cf_margin", "report_text_risk_density", "report_extraction_quality")
_UP = "CASE WHEN {0} IS NOT NULL THEN greatest({0}, 0) END"


def _rich_sql(body: str) -> str:
    start = sql("", "panel", "fund", "reports").rstrip()
    lag = "p.decision_date - x.publish_date <= 550"
    rich = (
        ", one AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY ticker, publish_date ORDER BY doc_id DESC) = 1)"
        ", p1 AS (SELECT p.*, f.net_debt / nullif(f.ebitda, 0) AS net_debt_to_ebitda, f.ebitda / nullif(abs(f.interest_expense), 0) AS interest_coverage, f.ebitda / nullif(f.revenue, 0) AS ebitda_margin, f.operating_cash_flow, f.free_cash_flow FROM panel p ASOF LEFT JOIN fund f ON p.ticker = f.ticker AND p.decision_date >= f.publish_date)"
        f", p2 AS (SELECT p.*, CAST(p.decision_date - x.publish_date AS INT) AS report_lag_days, CASE WHEN {lag} THEN 1.0::DOUBLE ELSE 0.0 END AS report_available, " + ", ".join(f"CASE WHEN {lag} THEN x.{c} END AS {c}" for c in _REPORTED) + " FROM p1 p ASOF LEFT JOIN one x ON p.ticker = x.ticker AND p.decision_date >= x.publish_date)"
        ", p3 AS (SELECT *, ln(1 + amihud_20d * 1e10) + ln(1 + spread_proxy * 100) - ln(1 + avg_daily_traded_value_20d / 1e7) AS ls, "
        + _UP.format("net_debt_to_ebitda") + " / (1 + " + _UP.format("interest_coverage") + ") AS ds, coalesce(free_cash_flow, 0) + 0.5 * coalesce(operating_cash_flow, 0) + 0.25 * coalesce(ebitda_margin, 0) AS cb, "
        + _UP.format("report_net_debt_to_ebitda") + " / (1 + " + _UP.format("report_interest_coverage") + ") AS lp, " + _UP.format("(-report_free_cf_margin)") + " + 25 * " + _UP.format("report_text_risk_density")
        + " AS cp, exp(-greatest(report_lag_days, 0) / 365.0::DOUBLE) * report_available * report_extraction_quality AS sw FROM p2) "
    )
    return start + rich + body


def rich(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with series, fundamentals and reports: the input of the derived features."""
    from tidemark.operators.asof import asof_reports

    df = asof_join(panel(spark, sf), fundamentals(spark, sf), "ticker", "decision_date", "publish_date", {c: f"fund_{c}" for c in feat.FUNDAMENTALS}, tie="report_date")
    df = feat.fundamental_ratios(df, "fund_").withColumns({c: F.col(f"fund_{c}") for c in ("free_cash_flow", "operating_cash_flow")})
    one = reports(spark, sf).groupBy("ticker", "publish_date").agg(F.max_by(F.struct(*_REPORTED), "doc_id").alias("x")).select("ticker", "publish_date", "x.*")
    return asof_reports(df, one, list(_REPORTED))


@query(_rich_sql("SELECT ticker, decision_date, CAST(coalesce(curve_slope < 0, false) AS INT) AS curve_inversion_flag, " + ", ".join(f"{q(e, n)} AS {c}" for c, (n, e) in _DERIVED.items()) + " FROM p3"))
def e_derived_features(spark: SparkSession, sf: str) -> DataFrame:
    """E1 to E17."""
    df = feat.derived_features(rich(spark, sf))
    return rounded(df, {c: n for c, (n, _) in _DERIVED.items()}).select("ticker", "decision_date", "curve_inversion_flag", *_DERIVED)


_CROSS = ("log_market_cap", "beta_60d", "rolling_vol_20d", "spread_proxy")


@query(sql("SELECT ticker, decision_date, " + ", ".join(f"{q(f'CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY decision_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY decision_date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY decision_date) END', 6)} AS {c}_cs_rank, {q(f'coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0)', 4)} AS {c}_sector_z" for c in _CROSS) + " FROM panel WINDOW s AS (PARTITION BY decision_date, sector)", "panel"))
def e18_cross_sectional(spark: SparkSession, sf: str) -> DataFrame:
    """E18 and E19."""
    df = feat.cross_sectional(panel(spark, sf), list(_CROSS))
    return rounded(df, {f"{c}_cs_rank": 6 for c in _CROSS} | {f"{c}_sector_z": 4 for c in _CROSS}).select("ticker", "decision_date", *(f"{c}_cs_rank" for c in _CROSS), *(f"{c}_sector_z" for c in _CROSS))


_ALL_RANKED = feat.RANKED
_RANK = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY decision_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY decision_date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY decision_date) END"
_DEVIATION = "coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0)"


@query(
    _rich_sql(
        f", p4 AS (SELECT *, {_DERIVED['report_integrated_stress'][1]} AS report_integrated_stress FROM p3) SELECT ticker, decision_date, CAST(coalesce(curve_slope < 0, false) AS INT) AS curve_inversion_flag, "
        + ", ".join(f"{q(e, n)} AS {c}" for c, (n, e) in _DERIVED.items() if c != "report_integrated_stress")
        + f", {q('report_integrated_stress', 5)} AS report_integrated_stress, "
        + ", ".join(f"{q(_RANK.format(c=c), 6)} AS {c}_cs_rank, {q(_DEVIATION.format(c=c), 4)} AS {c}_sector_z" for c in _ALL_RANKED)
        + " FROM p4 WINDOW s AS (PARTITION BY decision_date, sector)"
    )
)
def e20_augment(spark: SparkSession, sf: str) -> DataFrame:
    """E20: all that augment adds, for the whole panel."""
    out, added = feat.augment(rich(spark, sf))
    digits = {c: n for c, (n, _) in _DERIVED.items()} | {f"{c}_cs_rank": 6 for c in _ALL_RANKED} | {f"{c}_sector_z": 4 for c in _ALL_RANKED}
    return rounded(out.select("ticker", "decision_date", *added), digits)


# --- splits ------------------------------------------------------------------------------------------
_SPLIT = "CASE " + " ".join(f"WHEN decision_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in RANGES.items()) + " END"


@query(sql(f"SELECT * FROM (SELECT ticker, decision_date, {_SPLIT} AS split FROM keys) WHERE split IS NOT NULL", "keys"))
def s1_temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.temporal_split(keys(spark, sf), RANGES).select("ticker", "decision_date", "split")


_FOLDS = sql("SELECT f.fold, CASE WHEN m.i < 12 + (f.fold - 1) * 3 - 3 THEN 'train' WHEN m.i < 12 + (f.fold - 1) * 3 THEN 'validation' ELSE 'test' END AS role, m.month, m.i AS month_index FROM m JOIN f ON m.i < 12 + (f.fold - 1) * 3 + 3", "keys").replace(" SELECT f.fold", ", m AS (SELECT CAST(month AS DATE) AS month, CAST(row_number() OVER (ORDER BY month) - 1 AS INT) AS i FROM (SELECT DISTINCT date_trunc('month', decision_date) AS month FROM keys)), f AS (SELECT CAST(unnest(generate_series(1, 1000)) AS INT) AS fold), g AS (SELECT fold FROM f WHERE 12 + (fold - 1) * 3 + 3 <= (SELECT count(*) FROM m)) SELECT f.fold", 1).replace("JOIN f ON", "JOIN g f ON")


@query(_FOLDS)
def s2_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """S2 and S3."""
    return splits.walk_forward(keys(spark, sf)).select("fold", "role", "month", "month_index")


@query(_FOLDS.replace(" SELECT f.fold", ", l AS (SELECT ticker, decision_date, CASE WHEN ticker < 'Brand#15' THEN 'low' ELSE 'high' END AS risk_class FROM keys), roles AS (SELECT f.fold", 1) + "), x AS (SELECT r.fold, r.role, count(*) AS n, count(DISTINCT risk_class) AS k FROM roles r JOIN l ON date_trunc('month', l.decision_date) = r.month GROUP BY 1, 2) SELECT fold, max(CASE WHEN role = 'train' THEN n END) AS train_rows, max(CASE WHEN role = 'validation' THEN n END) AS validation_rows, max(CASE WHEN role = 'test' THEN n END) AS test_rows, min(k) >= 2 AND count(*) = 3 AS ok FROM x GROUP BY 1")
def s4_fold_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = keys(spark, sf).withColumn("risk_class", F.when(F.col("ticker") < "Brand#15", "low").otherwise("high"))
    return splits.fold_gate(splits.with_folds(rows, splits.walk_forward(rows))).select("fold", "train_rows", "validation_rows", "test_rows", "ok")


@query(sql(f"SELECT min(CASE WHEN split = 'train' THEN decision_date END) AS train_min, max(CASE WHEN split = 'train' THEN decision_date END) AS train_max, min(CASE WHEN split = 'validation' THEN decision_date END) AS validation_min, max(CASE WHEN split = 'validation' THEN decision_date END) AS validation_max, min(CASE WHEN split = 'test' THEN decision_date END) AS test_min, max(CASE WHEN split = 'test' THEN decision_date END) AS test_max, true AS ok FROM (SELECT decision_date, {_SPLIT} AS split FROM keys)", "keys"))
def s5_split_order(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_order(splits.temporal_split(keys(spark, sf), RANGES))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)")
def s6_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_partkey"])


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {q(f'avg(CASE WHEN {c} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS rate, count({c}) > 0 AS passed FROM comp" for c in COMPONENTS), "comp"))
def s7_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.completeness(components(spark, sf), list(COMPONENTS)), {"rate": 6})


@query("SELECT count(*) FILTER (TRY_CAST(d AS DATE) IS NULL) AS bad, min(TRY_CAST(d AS DATE)) AS first, max(TRY_CAST(d AS DATE)) AS last FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'never' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders)")
def s8_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return quality.date_parse(spark.read.parquet(f"{sf}/orders.parquet").select(text.alias("d")), "d")


@query(sql("SELECT 'columns' AS check, true AS passed, 0.0::DOUBLE AS value UNION ALL SELECT 'duplicate_keys', true, 0.0 UNION ALL SELECT 'dates', true, 0.0 UNION ALL " + " UNION ALL ".join(f"SELECT 'complete_{c}', count({c}) > 0, {q(f'avg(CASE WHEN {c} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)', 6)} FROM comp" for c in COMPONENTS), "comp"))
def s9_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.quality_report(components(spark, sf))
    return out.withColumn("value", F.when(F.col("check").startswith("complete"), r("value", 6)).otherwise(F.col("value")))


_DRIFT = ("l_quantity", "l_extendedprice", "l_discount", "flag")
_DRIFT_SQL = (
    "WITH b AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split, l_quantity, l_extendedprice * (1 + CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END) AS l_extendedprice, l_discount, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS flag FROM lineitem), "
    "l AS (" + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, {c} AS x FROM b" for c in _DRIFT) + "), "
    "e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM l WHERE split = 'train' GROUP BY 1), "
    "st AS (SELECT feature, split, count(x) AS n, avg(x) AS mean, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1, 2), "
    "p AS (SELECT s.feature, s.split AS period, s.n, s.mean, t.n AS tn, t.mean AS tmean, CASE WHEN len(e) <= 2 THEN list_transform(range(0, 11), lambda i: least(s.lo, t.lo) + (greatest(s.hi, t.hi) - least(s.lo, t.lo)) * i / 10) ELSE e END AS e FROM st s JOIN st t ON t.feature = s.feature AND t.split = 'train' JOIN e0 ON e0.feature = s.feature WHERE s.split <> 'train'), "
    "c AS (SELECT p.feature, p.period, len(list_filter(e[2:len(e) - 1], lambda v: v < x)) AS bin, count(*) FILTER (split = 'train') AS ec, count(*) FILTER (split <> 'train') AS ac FROM p JOIN l ON l.feature = p.feature AND l.split IN ('train', p.period) GROUP BY 1, 2, 3), "
    "g AS (SELECT feature, period, n, tn, unnest(range(0, len(e) - 1)) AS bin FROM p), "
    "z AS (SELECT g.feature, g.period, greatest(coalesce(ec, 0) / tn::DOUBLE, 1e-6) AS ep, greatest(coalesce(ac, 0) / n::DOUBLE, 1e-6) AS ap FROM g LEFT JOIN c ON c.feature = g.feature AND c.period = g.period AND c.bin = g.bin), "
    "s AS (SELECT feature, period, sum((ap - ep) * ln(ap / ep)) AS psi FROM z GROUP BY 1, 2) "
    f"SELECT p.feature, p.period, 0.0::DOUBLE AS train_missing_rate, 0.0::DOUBLE AS period_missing_rate, {q('tmean', 3)} AS train_mean, {q('mean', 3)} AS period_mean, {q('psi', 5)} AS psi, psi >= 0.2 AS drift_warning FROM p JOIN s ON s.feature = p.feature AND s.period = p.period"
)


@query(_DRIFT_SQL)
def s10_drift(spark: SparkSession, sf: str) -> DataFrame:
    """S10 and S11."""
    ship = F.col("l_shipdate")
    at = lambda d: F.lit(d).cast("timestamp")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = line.select(F.when(ship < at("1998-01-01"), "train").when(ship < at("2000-01-01"), "validation").otherwise("test").alias("split"), "l_quantity", (F.col("l_extendedprice") * (1 + F.when(ship >= at("2000-01-01"), 1).otherwise(0))).alias("l_extendedprice"), "l_discount", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("flag"))
    return rounded(fit.drift_report(rows, list(_DRIFT)), {"train_missing_rate": 6, "period_missing_rate": 6, "train_mean": 3, "period_mean": 3, "psi": 5})


# --- preprocessing -----------------------------------------------------------------------------------
_PRE = ("o_totalprice", "x")
_PRE_BASE = "b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN sin(o_orderkey) * 1000 END AS x, o_orderdate < TIMESTAMP '1999-01-01' AS tr FROM orders)"
_PRE_SQL = f"WITH {_PRE_BASE}, m AS (SELECT median(o_totalprice) AS m1, median(x) AS m2 FROM b WHERE tr), i AS (SELECT b.*, coalesce(o_totalprice, m1) AS i1, coalesce(x, m2) AS i2 FROM b, m), w AS (SELECT quantile_cont(i1, [0.01, 0.99]) AS q1, quantile_cont(i2, [0.01, 0.99]) AS q2 FROM i WHERE tr), s AS (SELECT i.*, sign(c1) * ln(1 + abs(c1)) AS l1, sign(c2) * ln(1 + abs(c2)) AS l2 FROM (SELECT i.*, least(greatest(i1, q1[1]), q1[2]) AS c1, least(greatest(i2, q2[1]), q2[2]) AS c2 FROM i, w) i), z AS (SELECT avg(l1) AS a1, stddev_samp(l1) AS s1, avg(l2) AS a2, stddev_samp(l2) AS s2 FROM s WHERE tr) "


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(k % 7 != 0, F.sin(k.cast("double")) * 1000).alias("x"), (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")).alias("tr"))


@query(_PRE_SQL + f"SELECT o_orderkey, {q('(l1 - a1) / s1', 4)} AS price_std, {q('(l2 - a2) / s2', 4)} AS x_std, CAST(o_orderstatus = 'F' AS DOUBLE) AS f, CAST(o_orderstatus = 'O' AS DOUBLE) AS o, CAST(o_orderstatus = 'P' AS DOUBLE) AS p FROM s, z")
def q1_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 to Q5, fitted on the train rows."""
    rows = _orders(spark, sf)
    pre = fit.Preprocessor(list(_PRE), ["o_orderstatus"]).fit(rows.filter("tr"))
    out = pre.transform(rows)
    return out.select("o_orderkey", r("o_totalprice_std").alias("price_std"), r("x_std").alias("x_std"), *(F.col(f"`o_orderstatus={s}`").alias(s.lower()) for s in "FOP"))


@query(_PRE_SQL + f"SELECT 'o_totalprice' AS feature, {q('m1', 3)} AS median, {q('q1[1]', 3)} AS lower, {q('q1[2]', 3)} AS upper, {q('a1', 5)} AS mean, {q('s1', 5)} AS scale FROM m, w, z UNION ALL SELECT 'x', {q('m2', 3)}, {q('q2[1]', 3)}, {q('q2[2]', 3)}, {q('a2', 5)}, {q('s2', 5)} FROM m, w, z")
def q1_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted parameters as a table."""
    pre = fit.Preprocessor(list(_PRE)).fit(_orders(spark, sf).filter("tr"))
    return rounded(pre.parameters(spark), {"median": 3, "lower": 3, "upper": 3, "mean": 5, "scale": 5})


@query(f"WITH {_PRE_BASE}, s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM b WHERE tr) SELECT o_orderkey, {q('(o_totalprice - m) / d')} AS z FROM b, s")
def q6_population_scaling(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf)
    mean, scale = fit.population_scaler(rows.filter("tr"), ["o_totalprice"])["o_totalprice"]
    return rows.select("o_orderkey", r((F.col("o_totalprice") - mean) / scale).alias("z"))


