"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators that may be zero but must not make a null.
EPS = 1e-12


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def floor_at(x: Column, low: float) -> Column:
    """x, but low where it is below; null stays null (greatest would make it low)."""
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def finite(x: Column) -> Column:
    """x as a double; null for what is not a number, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is null."""
    return F.when(condition, 1).otherwise(0)


def first_date(x: Column) -> Column:
    """A date written ISO first, else day first (dots, slashes or dashes); null if neither."""
    t = F.trim(x.cast("string"))
    iso = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    day = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(t, r"^(\d{1,2}[./-]\d{1,2}[./-]\d{4})", 1), "[/-]", "."), F.lit("d.M.yyyy"))
    return F.coalesce(iso, day).cast("date")
