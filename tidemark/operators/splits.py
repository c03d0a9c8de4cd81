"""Temporal and walk-forward splits, and the checks that belong to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, ranges: Mapping[str, tuple[str, str]], date: str = "decision_date", embargo_days: int = 0) -> DataFrame:
    """A column split by inclusive ranges; rows in none of them go.

    embargo_days drops that many last days of every range but the last, whose labels look into the next.
    """
    case, last = None, list(ranges)[-1]
    for name, (start, end) in ranges.items():
        end_ = F.date_sub(F.lit(end).cast("date"), embargo_days if name != last else 0)
        hit = F.col(date).between(F.lit(start).cast("date"), end_)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return df.withColumn("split", case).filter("split is not null")


def walk_forward(df: DataFrame, initial: int = 12, test: int = 3, step: int = 3, validation: int = 3, date: str = "decision_date") -> DataFrame:
    """(month_index, fold, role) of every month in every fold: train, validation (last months of train) and test.

    Folds open while initial + n * step + test months exist.  The months are few; df is only read for them.
    """
    months = df.select(F.trunc(date, "month").alias("month")).filter("month is not null").distinct().withColumn("month_index", F.row_number().over(Window.orderBy("month")) - 1)
    total = months.agg(F.count("*").cast("int").alias("months"))
    last = F.floor((F.col("months") - initial - test) / step).cast("int") + 1
    start = F.lit(initial) + (F.col("fold") - 1) * step
    folds = months.crossJoin(F.broadcast(total)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), last)))).filter(start + test <= F.col("months")).withColumn("start", start)
    role = F.when((F.col("month_index") < F.col("start") - validation) | (F.col("month_index") < F.col("start")) & (F.col("start") <= validation), "train").when(F.col("month_index") < F.col("start"), "validation").when(F.col("month_index") < F.col("start") + test, "test")
    return folds.withColumn("role", role).filter("role is not null").select("month", "month_index", "fold", "role")


def with_folds(df: DataFrame, folds: DataFrame, date: str = "decision_date") -> DataFrame:
    """Every row once per fold that its month is part of."""
    return df.withColumn("month", F.trunc(date, "month")).join(folds, "month").drop("month", "month_index")


def fold_gate(rows: DataFrame, label: str = "risk_class") -> DataFrame:
    """fold and ok: every part has rows and the train part two classes."""
    per = rows.groupBy("fold").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_rows") for r in ("train", "validation", "test")), *(F.count_distinct(F.when(F.col("role") == r, F.col(label))).alias(f"{r}_classes") for r in ("train", "validation", "test")))
    return per.withColumn("ok", (F.col("train_classes") >= 2) & (F.col("validation_classes") >= 2) & (F.col("test_classes") >= 2))


def split_order(df: DataFrame, date: str = "decision_date") -> DataFrame:
    """Ends of the splits and whether they are in order."""
    ends = [f(F.when(F.col("split") == s, F.col(date))).alias(f"{s}_{n}") for s in ("train", "validation", "test") for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(*ends).withColumn("ok", F.coalesce((F.col("train_max") < F.col("validation_min")) & (F.col("validation_max") < F.col("test_min")), F.lit(False)))
