"""Data-quality checks as rows (check, passed, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forward import COMPONENTS


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null values by column."""
    rates = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return rates.unpivot([], columns, "feature", "rate").withColumn("passed", F.coalesce(F.col("rate") > 0, F.lit(False)))


def date_parse(df: DataFrame, date: str) -> DataFrame:
    """Rows whose date is no date, and the ends of those that are."""
    parsed = F.col(date).try_cast("date")
    return df.agg(F.count_if(parsed.isNull()).alias("bad"), F.min(parsed).alias("first"), F.max(parsed).alias("last"))


def quality_report(df: DataFrame, keys: tuple[str, ...] = ("decision_date", "ticker"), date: str = "decision_date", components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """All checks; a missing column is a failed row, not an error."""
    spark, have = df.sparkSession, set(df.columns)
    absent = sorted({*keys, date, *components} - have)
    rows = [spark.createDataFrame([("columns", not absent, float(len(absent)))], "check string, passed boolean, value double")]
    if set(keys) <= have:
        rows.append(duplicate_keys(df, list(keys)).select(F.lit("duplicate_keys").alias("check"), (F.col("duplicates") == 0).alias("passed"), F.col("duplicates").cast("double").alias("value")))
    if date in have:
        rows.append(date_parse(df, date).select(F.lit("dates").alias("check"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("double").alias("value")))
    if there := [c for c in components if c in have]:
        rows.append(completeness(df, there).select(F.concat(F.lit("complete_"), "feature").alias("check"), "passed", F.col("rate").alias("value")))
    return reduce(DataFrame.unionByName, rows)
