"""Point-in-time joins: each left row takes the last right row published by its date, and nothing later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_series(left: DataFrame, series: DataFrame, left_date: str = "decision_date", date: str = "date", tolerance_days: int | None = None) -> DataFrame:
    """The last row of a keyless series (a row per date) with date <= left_date, whole with its nulls.

    Only the distinct dates of both sides are put in a global order (one row per calendar day); the left rows
    then join by equal date.
    """
    columns = [c for c in series.columns if c != date]
    right = series.select(F.col(date).alias("_d"), F.struct(date, *columns).alias("_row"))
    dates = left.select(F.col(left_date).alias("_d")).distinct().filter("_d is not null")
    both = dates.withColumn("_row", F.lit(None).cast(right.schema["_row"].dataType)).withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(0)))
    seen = F.last("_row", ignorenulls=True).over(Window.orderBy("_d", "_s").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_row", seen).filter("_s = 1")
    if tolerance_days is not None:
        found = found.withColumn("_row", F.when(F.datediff("_d", f"_row.{date}") <= tolerance_days, F.col("_row")))
    found = found.select(F.col("_d").alias(left_date), *(F.col(f"_row.{c}").alias(c) for c in columns))
    return left.join(found, left_date, "left")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: dict[str, str], tie: Column | str | None = None, split: Column | None = None) -> DataFrame:
    """The last right row of the same key with right_time <= left_time.

    columns: right column -> name in the result.  tie orders right rows of equal time; the last wins.  Both
    sides are united and read in order, so there is one exchange by key and no range join.

    split: an expression on a time column ``t`` that never falls over time (such as its month).  With it a key's rows are
    dealt by (key, split), and what earlier parts hold is carried over from one row per part: for keys that
    hold a large share of all rows.
    """
    tie = F.col(tie) if isinstance(tie, str) else tie if tie is not None else F.lit(0)
    row = F.struct(*(F.col(c).alias(n) for c, n in columns.items()))
    r = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("t"), F.lit(0).alias("_s"), tie.alias("_tie"), row.alias("_row"))
    kinds = {f.name: f.dataType for f in r.schema.fields}
    x = left.select(F.col(key).alias("_k"), F.col(left_time).alias("t"), F.lit(1).alias("_s"), F.lit(None).cast(kinds["_tie"]).alias("_tie"), F.lit(None).cast(kinds["_row"]).alias("_row"), F.struct(*left.columns).alias("_left"))
    both = r.withColumn("_left", F.lit(None).cast(x.schema["_left"].dataType)).unionByName(x)
    parts = ["_k"]
    if split is not None:
        both, parts = both.withColumn("_p", split), ["_k", "_p"]
    order = Window.partitionBy(*parts).orderBy("t", "_s", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_row", F.last("_row", ignorenulls=True).over(order))
    if split is not None:
        latest = both.groupBy("_k", "_p").agg(F.max_by("_row", F.when(F.col("_s") == 0, F.struct("t", "_tie"))).alias("_end"))
        earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        carried = latest.select("_k", "_p", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        out = out.filter("_s = 1").join(carried.withColumnsRenamed({"_k": "_k2", "_p": "_p2"}), F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_p").eqNullSafe(F.col("_p2")), "left").withColumn("_row", F.coalesce("_row", "_carried"))
    return out.filter("_s = 1").select("_left.*", *(F.col(f"_row.{n}").alias(n) for n in columns.values()))


def asof_reports(panel: DataFrame, reports: DataFrame, features: list[str], max_lag_days: int | None = 550, key: str = "ticker", date: str = "decision_date", tie: Sequence[str] = ()) -> DataFrame:
    """Joins report features by publish_date; features of reports older than max_lag_days are nulled.

    Of a key's reports of one day the one of the last period end wins, of these the last in the order of the tie columns.

    Adds report_publish_date, report_lag_days, report_available and report_stale_flag.
    """
    named = {c: c for c in features} | {"publish_date": "report_publish_date"}
    if "report_document_available" in reports.columns:
        named["report_document_available"] = "report_document_available"
    ties = [c for c in ("report_period_end",) if c in reports.columns] + list(tie)
    df = asof_join(panel, reports, key, date, "publish_date", named, tie=F.struct(*ties) if ties else None)
    available = F.coalesce(F.col("report_document_available").cast("double"), F.lit(0.0)) if "report_document_available" in df.columns else F.col("report_publish_date").isNotNull().cast("double")
    df = df.withColumns({"report_lag_days": F.datediff(date, "report_publish_date"), "report_available": available})
    stale = F.lit(False) if max_lag_days is None else F.coalesce(F.col("report_lag_days") > max_lag_days, F.lit(True))
    return df.withColumn("_stale", stale).withColumns({"report_stale_flag": F.col("_stale").cast("double"), "report_available": F.when(F.col("_stale"), 0.0).otherwise(F.col("report_available")), **{c: F.when(~F.col("_stale"), F.col(c)) for c in features}}).drop("_stale")


def align_series(calendar: DataFrame, series: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """All series on the calendar's dates, each with its last value by then, in one pass.

    series: name -> (date, value).  Everything has a row per calendar day at most, and is ordered globally.
    """
    both = calendar.select(F.col(date).alias("_d"), F.lit(1).alias("_s"), *(F.lit(None).cast("double").alias(n) for n in series))
    for name, df in series.items():
        both = both.unionByName(df.select(F.col(date).alias("_d"), F.lit(0).alias("_s"), F.col("value").cast("double").alias(name)), allowMissingColumns=True)
    seen = Window.orderBy("_d", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({n: F.last(n, ignorenulls=True).over(seen) for n in series}).filter("_s = 1").drop("_s").withColumnRenamed("_d", date)
