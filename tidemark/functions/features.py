"""Derived and cross-sectional features of the monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import EPS, clip, divide, finite, flag, floor_at
from tidemark.functions.longform import to_lines, to_rows

# The features that are ranked within a date.
RANKED = ("log_market_cap", "beta_60d", "rolling_vol_20d", "downside_vol_60d", "amihud_20d", "avg_daily_traded_value_20d", "spread_proxy", "turnover_ratio", "net_debt_to_ebitda", "interest_coverage", "free_cash_flow", "report_financial_pressure", "report_net_debt_to_ebitda", "report_interest_coverage", "report_free_cf_margin", "report_text_risk_density", "report_lag_days", "report_integrated_stress")
FUNDAMENTALS = ("net_debt", "ebitda", "interest_expense", "revenue", "book_equity", "operating_cash_flow", "free_cash_flow")
REPORT_MARKS = ("report_financial_pressure", "report_net_debt_to_ebitda", "report_text_risk_density", "report_available")


def fundamental_ratios(df: DataFrame, prefix: str = "") -> DataFrame:
    """Ratios and flags of missing inputs; absent inputs count as null."""
    have = set(df.columns)
    x = {c: F.col(prefix + c) if prefix + c in have else F.lit(None).cast("double") for c in (*FUNDAMENTALS, "market_cap")}
    if "market_cap" in have:
        x["market_cap"] = F.col("market_cap")
    either = lambda a, b: flag(x[a].isNull() | x[b].isNull())
    return df.withColumns(
        {
            "net_debt_to_ebitda_missing": either("net_debt", "ebitda"),
            "interest_coverage_missing": either("ebitda", "interest_expense"),
            "cash_flow_missing": either("operating_cash_flow", "free_cash_flow"),
            "net_debt_to_ebitda": divide(x["net_debt"], x["ebitda"]),
            "interest_coverage": divide(x["ebitda"], F.abs(x["interest_expense"])),
            "ebitda_margin": divide(x["ebitda"], x["revenue"]),
            "book_to_market": divide(x["book_equity"], x["market_cap"]),
        }
    )


def derived_features(df: DataFrame) -> DataFrame:
    """Interactions and stress measures; absent inputs count as 0 (365 for the report's lag)."""
    have = set(df.columns)

    def x(c: str, default: float = 0.0) -> Column:
        return finite(F.col(c)) if c in have else F.lit(default)

    up = lambda c: floor_at(c, 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    beta, vol, value = x("beta_60d"), x("rolling_vol_20d"), x("avg_daily_traded_value_20d")
    stress = F.log1p(x("amihud_20d") * 1e10) + F.log1p(x("spread_proxy") * 100.0) - F.log1p(value / 1e7)
    service = up(x("net_debt_to_ebitda")) / (1.0 + up(x("interest_coverage")))
    buffer = zero(x("free_cash_flow")) + 0.50 * zero(x("operating_cash_flow")) + 0.25 * zero(x("ebitda_margin"))
    new = {
        "downside_to_total_vol": zero(divide(x("downside_vol_60d"), vol + EPS)),
        "liquidity_stress": stress,
        "liquidity_vol_interaction": stress * vol,
        "beta_vol_interaction": beta * vol,
        "macro_pressure": 0.05 * x("key_rate") + 10.0 * x("market_vol_20d") + 0.50 * x("market_corr_60d") - 0.10 * x("curve_slope"),
        "rate_fx_pressure": x("key_rate") * F.log1p(up(x("fx_rate"))),
        "curve_inversion_flag": flag(x("curve_slope") < 0),
        "debt_service_stress": service,
        "cashflow_buffer": buffer,
        "size_liquidity_interaction": x("log_market_cap") * F.log1p(value),
        "momentum_reversal_risk": up(-x("momentum_6m")) * (1.0 + up(beta)),
        "fundamental_fragility": service - buffer,
    }
    if have & set(REPORT_MARKS):
        leverage = up(x("report_net_debt_to_ebitda")) / (1.0 + up(x("report_interest_coverage")))
        cash = up(-x("report_free_cf_margin")) + up(x("report_text_risk_density")) * 25.0
        weight = F.exp(-up(x("report_lag_days", 365.0)) / 365.0) * clip(x("report_available"), 0, 1) * clip(x("report_extraction_quality"), 0, 1)
        integrated = (0.45 * up(x("report_financial_pressure")) + 0.30 * leverage + 0.25 * cash) * zero(weight)
        new |= {"report_leverage_pressure": leverage, "report_cashflow_pressure": cash, "report_staleness_weight": weight, "report_integrated_stress": integrated, "fundamental_report_gap": service - buffer - integrated}
    return df.withColumns({c: e if c == "curve_inversion_flag" else finite(e) for c, e in new.items()})


def percent_rank_average(c: str, by: list[str]) -> Column:
    """Average-tie rank of non-null values over their number; null for nulls."""
    x = F.col(c)
    place, peers = Window.partitionBy(*by).orderBy(F.asc_nulls_last(c)), Window.partitionBy(*by, c)
    return F.when(x.isNotNull(), (F.rank().over(place) + (F.count(F.lit(1)).over(peers) - 1) / 2) / F.count(x).over(Window.partitionBy(*by)))


def cross_sectional(df: DataFrame, features: list[str], date: str = "decision_date", sector: str = "sector") -> DataFrame:
    """Adds <c>_cs_rank (rank within the date) and <c>_sector_z (deviation within date and sector, else 0).

    Two exchanges for all features: values by date and feature, where ranks and the sector's moments are windows, and
    the rows again by number.  A window holds one feature's values of one date, one per security.  Rows without a date
    have no rank and deviation 0.
    """
    have = [c for c in features if c in df.columns]
    if not have:
        return df
    by_sector = sector in df.columns
    keys = {"_date": F.col(date)} | ({"_sector": F.col(sector)} if by_sector else {})
    lines = to_lines(df, {c: finite(F.col(c)) for c in have}, keys)
    # lines of rows, and of rows without a date, are spread by their number
    alone = F.when(F.col("_date").isNull(), F.col("_id"))
    whole = Window.partitionBy("_date", "_name", "_alone")
    place, peers = whole.orderBy("_x"), Window.partitionBy("_date", "_name", "_alone", "_x")
    ranked = lines.withColumn("_alone", alone).withColumn("_rank", (F.rank().over(place) + (F.count("*").over(peers) - 1) / 2) / F.count("*").over(whole))
    ranked = ranked.withColumn("_rank", F.when(F.col("_date").isNotNull(), F.col("_rank")))
    results = {f"{c}_cs_rank": (c, "_rank") for c in have}
    if by_sector:
        own = Window.partitionBy("_date", "_name", "_alone", "_sector")
        ranked = ranked.withColumn("_z", finite(divide(F.col("_x") - F.avg("_x").over(own), F.stddev_samp("_x").over(own))))
        results |= {f"{c}_sector_z": (c, "_z") for c in have}
    out = to_rows(ranked, df.columns, results)
    return out.withColumns({f"{c}_sector_z": F.coalesce(F.col(f"{c}_sector_z"), F.lit(0.0)) for c in have}) if by_sector else out


def augment(df: DataFrame, ranked: tuple[str, ...] = RANKED) -> tuple[DataFrame, list[str]]:
    """All derived and cross-sectional features, and the names of the added columns."""
    out = cross_sectional(derived_features(df), list(ranked))
    return out, [c for c in out.columns if c not in df.columns]
