"""Evaluation: all scores come from nine confusion counts or plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import divide
from tidemark.operators.fit import CLASSES


def _counts(y: str, pred: str, weight: Column | None = None) -> list[Column]:
    one = weight if weight is not None else F.lit(1)
    return [F.sum(F.when((F.col(y) == a) & (F.col(pred) == b), one).otherwise(0)).alias(f"_{i}{j}") for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)]


def _cell(i: int, j: int) -> Column:
    return F.col(f"_{i}{j}")


def _true(i: int) -> Column:
    return sum((_cell(i, j) for j in range(1, 3)), _cell(i, 0))


def _called(j: int) -> Column:
    return sum((_cell(i, j) for i in range(1, 3)), _cell(0, j))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _f1(i: int) -> Column:
    return _zero(divide(2.0 * _cell(i, i), _true(i) + _called(i)))


def macro_f1() -> Column:
    return (_f1(0) + _f1(1) + _f1(2)) / 3


def high_recall() -> Column:
    return _cell(2, 2) / F.greatest(_true(2), F.lit(1))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Nine counts per group (sums of weight, if given), with which all scores are expressions."""
    return df.groupBy(*by).agg(*_counts(y, pred, F.col(weight) if weight else None))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """truth, low, medium, high: the 3 x 3 matrix in fixed order, zeros kept."""
    cells = F.array(*(F.struct(F.lit(a).alias("truth"), *(_cell(i, j).alias(b) for j, b in enumerate(CLASSES))) for i, a in enumerate(CLASSES)))
    return confusion(df, y, pred).select(F.inline(cells))


def classification_scores(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Macro and weighted F1, balanced accuracy, high recall and precision, false negatives, adjacent accuracy."""
    place = lambda c: F.when(F.col(c) == "low", 0).when(F.col(c) == "medium", 1).when(F.col(c) == "high", 2).otherwise(99)
    near = F.avg((F.abs(place(y) - place(pred)) <= 1).cast("double")).alias("adjacent_accuracy")
    n = _true(0) + _true(1) + _true(2)
    recall = [divide(1.0 * _cell(i, i), _true(i)) for i in range(3)]
    present = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in recall[1:]), F.when(recall[0].isNotNull(), 1).otherwise(0))
    weighted = divide(sum((_f1(i) * _true(i) for i in (1, 2)), _f1(0) * _true(0)), n)
    return df.groupBy(*by).agg(*_counts(y, pred), near).select(
        *by,
        macro_f1().alias("macro_f1"),
        weighted.alias("weighted_f1"),
        divide(_zero(recall[0]) + _zero(recall[1]) + _zero(recall[2]), present).alias("balanced_accuracy"),
        _zero(divide(1.0 * _cell(2, 2), _true(2))).alias("high_recall"),
        _zero(divide(1.0 * _cell(2, 2), _called(2))).alias("high_precision"),
        (1 - high_recall()).alias("high_false_negative_rate"),
        "adjacent_accuracy",
    )


def calibration(df: DataFrame, y: str = "y", pred: str = "pred", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the confidence, the mean confidence and the mean p_high."""
    sure = F.greatest("p_low", "p_medium", "p_high")
    # explicit edges: floor(confidence * bins) misplaces values at an edge
    number = F.lit(-1)
    for i in range(bins):
        number = number + (sure >= F.lit(i / bins)).cast("int")
    per = df.select(sure.alias("c"), (F.col(y) == F.col(pred)).cast("double").alias("hit"), "p_high", number.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("hit").alias("hit"), F.sum("p_high").alias("p"))
    n = F.sum("n")
    return per.agg((F.sum(F.abs(F.col("hit") - F.col("c"))) / n).alias("ece"), (F.sum("c") / n).alias("mean_confidence"), (F.sum("p") / n).alias("mean_p_high"))


def classwise(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """precision, recall, F1 and support of each class."""
    rows = F.array(*(F.struct(F.lit(c).alias("class"), _zero(divide(1.0 * _cell(i, i), _called(i))).alias("precision"), _zero(divide(1.0 * _cell(i, i), _true(i))).alias("recall"), _f1(i).alias("f1"), _true(i).alias("support")) for i, c in enumerate(CLASSES)))
    return confusion(df, y, pred).select(F.inline(rows))


def monotonicity(df: DataFrame, components: list[str], pred: str = "pred") -> DataFrame:
    """Mean of each component by predicted class, and whether they never fall from low to high (nulls skipped)."""
    long = df.select(pred, *components).unpivot([pred], components, "component", "x")
    means = long.groupBy("component").agg(*(F.avg(F.when(F.col(pred) == c, F.col("x"))).alias(c) for c in CLASSES))
    falls = (F.col("medium") < F.col("low") - 1e-12) | (F.col("high") < F.coalesce("medium", "low") - 1e-12)
    return means.withColumn("monotone", ~F.coalesce(falls, F.coalesce(F.col("medium") < F.col("low") - 1e-12, F.lit(False)) | F.coalesce(F.col("high") < F.coalesce("medium", "low") - 1e-12, F.lit(False))))


def importance_merge(a: DataFrame, b: DataFrame, weight_a: float = 0.5, weight_b: float = 0.5) -> DataFrame:
    """Two tables (feature, importance) by full outer join, absent ones 0, weighted."""
    x, y = a.select("feature", F.col("importance").alias("_a")), b.select("feature", F.col("importance").alias("_b"))
    return x.join(y, "feature", "full").na.fill(0.0).select("feature", (F.col("_a") * weight_a + F.col("_b") * weight_b).alias("importance"))


def metric_delta(base: DataFrame, other: DataFrame) -> DataFrame:
    """metric, baseline, enhanced and delta of two one-row score tables."""
    names = base.columns
    x = base.unpivot([], names, "metric", "baseline")
    y = other.select(*names).unpivot([], names, "metric", "enhanced")
    return x.join(y, "metric", "full").withColumn("delta", F.col("enhanced") - F.col("baseline"))
