"""Precision, recall, F1 and accuracy from counts, guarded (0 where nothing is divided) or not (null, never NaN)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, guarded: bool) -> Column:
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(ratio, F.lit(0.0)) if guarded else ratio


def precision(guarded: bool = True) -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"), guarded)


def recall(guarded: bool = True) -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"), guarded)


def f1(guarded: bool = True) -> Column:
    p, r = precision(guarded), recall(guarded)
    return _ratio(F.lit(2.0) * p * r, p + r, guarded)


def accuracy() -> Column:
    return _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), True)


def smoothed_f1(epsilon: float = 1e-6) -> Column:
    """F1 with a small number in each denominator."""
    p = F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(epsilon))
    r = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(epsilon))
    return F.lit(2.0) * p * r / (p + r + F.lit(epsilon))
