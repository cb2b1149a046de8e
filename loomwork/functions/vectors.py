"""Column functions over feature vectors (arrays of numbers), computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums over rows are made of integers of this unit, so that they don't depend on the order of rows.
UNIT = 1_000_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector of length 1; a zero vector gives nulls. (The norm is repeated as an array, so it is computed once a row.)"""
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: F.try_divide(x, n))


def scaled(v: Column, factor: float | Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def midpoint(a: Column, b: Column) -> Column:
    """The mean of two vectors; it isn't normalised again."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def micro(x: Column) -> Column:
    """A number as whole millionths, rounded half up: the same in every engine."""
    return F.floor(x * UNIT + 0.5).cast("long")


def mean_vectors(rows: DataFrame, by: list[str], vec: str, out: str = "vec") -> DataFrame:
    """The mean vector of each group, from exact sums of millionths: partial sums by (group, place), then one row a group."""
    places = rows.select(*by, F.posexplode(vec).alias("_i", "_x"))
    sums = places.groupBy(*by, "_i").agg((F.sum(F.floor(F.col("_x") * UNIT).cast("long")) / F.lit(float(UNIT)) / F.count("*")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"])
    return sums.groupBy(*by).agg(ordered.alias(out))
