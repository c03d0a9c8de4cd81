"""The point-in-time panel: daily rows to one row per key and month, joined with everything published by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.features import FUNDAMENTALS, fundamental_ratios
from tidemark.operators.asof import asof_join, asof_reports, asof_series
from tidemark.operators.forward import target_components
from tidemark.operators.rolling import daily_features, monthly_snapshot
from tidemark.sources.tables import require


def in_universe(df: DataFrame, members: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows of included keys."""
    return df.join(members.filter("include_flag = 1").select(key).distinct(), key, "left_semi")


def attach_sector(panel: DataFrame, members: DataFrame, key: str = "ticker") -> DataFrame:
    """The universe's sector where the panel has none; else unknown."""
    own = panel.withColumnRenamed("sector", "_own") if "sector" in panel.columns else panel.withColumn("_own", F.lit(None).cast("string"))
    sectors = members.groupBy(key).agg(F.min("sector").alias("sector"))
    return own.join(sectors, key, "left").withColumn("sector", F.coalesce("_own", "sector", F.lit("unknown"))).drop("_own")


def build_panel(daily: DataFrame, members: DataFrame | None = None, benchmark: DataFrame | None = None, macro: DataFrame | None = None, fundamentals: DataFrame | None = None, reports: DataFrame | None = None, report_columns: list[str] | None = None, horizon: int | None = 126) -> DataFrame:
    """One lazy plan: universe, daily features, snapshot, series, sector, fundamentals, ratios, reports, targets.

    Fundamentals come with the prefix fund_ and reports with their own names, so that no names clash.
    """
    require(daily, "daily_prices")
    if members is not None:
        daily = in_universe(daily, members)
    panel = monthly_snapshot(daily_features(daily, benchmark))
    if macro is not None:
        panel = asof_series(panel, require(macro, "macro"))
    if members is not None:
        panel = attach_sector(panel, members)
    if fundamentals is not None:
        require(fundamentals, "fundamentals")
        named = {c: f"fund_{c}" for c in (*FUNDAMENTALS, "report_date", "publish_date") if c in fundamentals.columns}
        panel = fundamental_ratios(asof_join(panel, fundamentals, "ticker", "decision_date", "publish_date", named, tie="report_date"), "fund_")
        panel = panel.withColumns({"free_cash_flow": F.col("fund_free_cash_flow") if "fund_free_cash_flow" in panel.columns else F.lit(None).cast("double"), "operating_cash_flow": F.col("fund_operating_cash_flow") if "fund_operating_cash_flow" in panel.columns else F.lit(None).cast("double")})
    if reports is not None:
        panel = asof_reports(panel, reports, report_columns or [c for c in reports.columns if c.startswith("report_") and c not in ("report_period_end", "report_type", "report_document_available")])
    return target_components(panel, daily, horizon) if horizon else panel
