"""Exact order statistics and percentiles of groups, found by counting instead of sorting.

The values of a group lie between two bounds that are cut into `CELLS` equal cells. Values are counted by cell (partial sums, a few rows
for each group), a running sum tells the cell in which the wanted rank lies, and only that cell's values are looked at again, between its own
least and largest value. The bounds differ or the value is found, so each pass parts at least the least from the largest. A group that
holds most of all rows is counted by all tasks; no task orders a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import stored

CELLS = 1024


def _cell(value: Column, low: Column, high: Column) -> Column:
    """Which of the cells between two bounds a value lies in; never falls as values rise."""
    place = F.floor((value - low) / (high - low) * F.lit(float(CELLS)))
    return F.when(high > low, F.greatest(F.lit(0), F.least(place, F.lit(CELLS - 1)))).otherwise(F.lit(0)).cast("int")


def order_statistics(rows: DataFrame, wanted: DataFrame, group: str, value: str) -> DataFrame:
    """(group, rank, value) for each row of `wanted` (group, rank), ranks from 0; a rank that the group hasn't has none.

    Nulls and NaN have no rank. A null group is a group.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    asked = wanted.select(F.col(group).alias("_w"), F.col("rank").cast("long").alias("_rank")).distinct()
    open_ = stored(asked.join(ends, F.col("_w").eqNullSafe(F.col("_g"))).where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n"))).select("_w", "_rank", F.lit(0).cast("long").alias("_below"), "_low", "_high"))
    while open_.where("_low < _high").limit(1).count():
        # one row of bounds for each rank; values outside them have been counted
        met = rows.join(open_, rows["_g"].eqNullSafe(open_["_w"]) & F.col("_v").between(F.col("_low"), F.col("_high")))
        cells = met.groupBy("_w", "_rank", _cell(F.col("_v"), F.col("_low"), F.col("_high")).alias("_c"))
        cells = cells.agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_below").alias("_below"))
        upto = Window.partitionBy("_w", "_rank").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
        reached = cells.withColumn("_upto", F.col("_below") + F.sum("_n").over(upto)).where(F.col("_upto") > F.col("_rank"))
        first = reached.groupBy("_w", "_rank").agg(F.min(F.struct("_c", "_upto", "_n", "_least", "_most")).alias("f"))
        open_ = stored(first.select("_w", "_rank", (F.col("f._upto") - F.col("f._n")).alias("_below"), F.col("f._least").alias("_low"), F.col("f._most").alias("_high")))
    return open_.select(F.col("_w").alias(group), F.col("_rank").alias("rank"), F.col("_low").alias("value"))


def exact_percentiles(rows: DataFrame, group: str, value: str, share: float, out: str = "edge") -> DataFrame:
    """(group, out): the percentile of each group's values, between two of them in proportion; groups without values have none."""
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group).alias("_w")).agg(((F.count("*") - 1) * F.lit(share)).alias("_at"))
    spots = stored(counted.select("_w", "_at", F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi")))
    found = order_statistics(rows, spots.select(F.col("_w").alias(group), F.explode(F.array("_lo", "_hi")).alias("rank")), group, value)
    met = spots.join(found, spots["_w"].eqNullSafe(found[group])).groupBy("_w", "_at", "_lo")
    ends = met.agg(F.max(F.when(F.col("rank") == F.col("_lo"), F.col("value"))).alias("_a"), F.max("value").alias("_b"))
    return ends.select(F.col("_w").alias(group), (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))).alias(out))
