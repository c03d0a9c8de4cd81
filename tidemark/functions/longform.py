"""Rows as one line per column and back, so that work on many columns takes two exchanges, however many they are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The name of the line that holds a row's own columns.
ROW = ""


def to_lines(df: DataFrame, values: Mapping[str, Column], keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Lines (_id, keys, _name, _x, _row): one per non-null value, and one of name ROW with the row's columns in _row.

    Keys are null on ROW lines.  _id numbers the rows of one execution.  Rows are sorted by keys and values within their
    partition first: a task done again may number rows otherwise only where all of these are equal, which changes no
    result of lines brought back by to_rows.
    """
    keys = dict(keys or {})
    wide = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(k.alias(f"_k{i}") for i, k in enumerate(keys.values())), *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())))
    kind = wide.schema["_row"].dataType
    order = wide.columns[1:]
    wide = (wide.sortWithinPartitions(*order) if order else wide).withColumn("_id", F.monotonically_increasing_id())
    own = F.struct(F.lit(ROW).alias("_name"), F.lit(None).cast("double").alias("_x"), F.col("_row"))
    others = [F.struct(F.lit(n).alias("_name"), F.col(f"_v{i}").alias("_x"), F.lit(None).cast(kind).alias("_row")) for i, n in enumerate(values)]
    lines = wide.select("_id", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.explode(F.array(own, *others)).alias("_l"))
    lines = lines.select("_id", *keys, "_l.*").filter((F.col("_name") == ROW) | F.col("_x").isNotNull())
    # what is keyed meets its like in one task; rows themselves have no business there
    return lines.withColumns({k: F.when(F.col("_name") != ROW, F.col(k)) for k in keys}) if keys else lines


def to_rows(lines: DataFrame, columns: list[str], results: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The rows again, with results: new column -> (name of the line, column of the line)."""
    picked = [F.max(F.when(F.col("_name") == name, F.col(value))).alias(f"_r{i}") for i, (name, value) in enumerate(results.values())]
    rows = lines.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), *picked)
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in columns), *(F.col(f"_r{i}").alias(n) for i, n in enumerate(results)))
