"""A panel whose targets rise with report stress, and the paired run that shows what report features add."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite
from tidemark.functions.features import percent_rank_average
from tidemark.operators.forward import COMPONENTS

# The weights of the stress sum, and how much the largest stress of a month adds to a target.
STRESS = {"report_financial_pressure": 1.0, "report_sanctions_flag": 0.10, "report_liquidity_refinancing_flag": 0.08, "report_covenant_flag": 0.06}
GAIN = 0.22


def stress_sum(columns: Sequence[str], weights: Mapping[str, float] = STRESS) -> Column:
    """The weighted sum; absent columns, nulls and what is no finite number count as 0."""
    parts = [w * F.coalesce(finite(F.col(c)), F.lit(0.0)) for c, w in weights.items() if c in columns]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def stress_adjusted(panel: DataFrame, weights: Mapping[str, float] = STRESS, gain: float = GAIN, targets: Sequence[str] = COMPONENTS, date: str = "decision_date") -> DataFrame:
    """panel with ``stress``, ``stress_rank`` and its targets times ``1 + gain * stress_rank``.

    The rank is the share within the month, equal sums at their average rank; rows without a date have rank 0.  One
    exchange by month, whose rows are one per security.  Absent targets stay absent, null ones null.
    """
    ranked = panel.withColumn("stress", stress_sum(panel.columns, weights)).withColumn("_month", F.trunc(date, "month"))
    # rows without a month are ranked with nothing, and alone
    ranked = ranked.withColumn("_alone", F.when(F.col("_month").isNull(), F.xxhash64(*(F.col(f"`{c}`") for c in panel.columns))))
    rank = F.when(F.col("_month").isNotNull(), percent_rank_average("stress", ["_month", "_alone"]))
    ranked = ranked.withColumn("stress_rank", F.coalesce(rank, F.lit(0.0)))
    have = [c for c in targets if c in panel.columns]
    return ranked.withColumns({c: F.col(c).cast("double") * (1.0 + gain * F.col("stress_rank")) for c in have}).drop("_month", "_alone")
