"""Decision thresholds: sweeps over fixed and data-dependent grids, best points, hyper-parameters.

A sweep doesn't compare every score with every threshold. Scores are put into the bucket of the last grid point that they
reach, buckets are counted (partial sums, one small shuffle), and counts at or above each point are a running sum over the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.bounded import bounded
from loomwork.operators.metrics import with_figures

STEPS = 1000


def grid_bucket(score: Column, steps: int = STEPS) -> Column:
    """The largest i with i / steps <= score, at most `steps`; below 0 for scores below 0. Corrected for rounding at grid points."""
    rough = F.floor(score * steps).cast("long")
    exact = F.when(score >= (rough + 1) / F.lit(float(steps)), rough + 1).when(score < rough / F.lit(float(steps)), rough - 1).otherwise(rough)
    return F.least(exact, F.lit(steps).cast("long"))


def _curve(buckets: DataFrame, by: list[str], grid: DataFrame) -> DataFrame:
    """Counts at each grid point i: buckets (by, b, pos, neg), grid (by, i, threshold)."""
    totals = buckets.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    cells = grid.join(totals, by).join(buckets.withColumnRenamed("b", "i"), [*by, "i"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    counts = cells.withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(above), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(above)})
    return counts.select(*by, "i", "threshold", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"))


def fixed_sweep(scores: DataFrame, by: list[str], positive: Column, score: str = "sim", steps: int = STEPS) -> DataFrame:
    """(by, i, threshold, tp, fp, tn, fn, precision, recall, f1) at 0, 1/steps ... 1; figures without a divisor are 0."""
    rows = scores.select(*by, grid_bucket(F.col(score), steps).alias("b"), positive.alias("_y"))
    buckets = rows.groupBy(*by, "b").agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    spine = scores.sparkSession.range(steps + 1).select(F.col("id").alias("i"), (F.col("id") / F.lit(float(steps))).alias("threshold"))
    grid = buckets.select(*by).distinct().crossJoin(F.broadcast(spine))
    return with_figures(_curve(buckets, by, grid))


def best_point(curve: DataFrame, by: list[str]) -> DataFrame:
    """The row of the largest F1 of each group; of equal ones that of the lowest threshold. Rows without F1 never win."""
    columns = [c for c in curve.columns if c not in by]
    best = F.max_by(F.struct(*columns), F.struct("f1", -F.col("threshold")))
    return curve.where("f1 is not null").groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def _spaced_sweep(scores: DataFrame, by: list[str], positive: Column, score: str, ranges: DataFrame) -> DataFrame:
    """Sweep over linspace(lo, hi, n) of each group; ranges: (by, lo, hi, n), bounded."""
    ranges = bounded(ranges)
    step = F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1))

    def point(i: Column) -> Column:  # as linspace: the last one is hi itself
        return F.when(i == 0, F.col("lo")).when(i == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + i * F.col("_step"))

    rows = scores.withColumn("_y", positive).join(ranges.withColumn("_step", step), by)
    rough = F.when(F.col("_step") > 0, F.floor((F.col(score) - F.col("lo")) / F.col("_step")).cast("long")).otherwise(F.when(F.col(score) >= F.col("lo"), F.col("n") - 1).otherwise(-1))
    rough = F.greatest(F.lit(-1).cast("long"), F.least(rough, F.col("n").cast("long") - 1))
    rows = rows.withColumn("_r", rough)
    r = F.col("_r")
    reached = F.when((r + 1 < F.col("n")) & (F.col(score) >= point(r + 1)), r + 1).when((r >= 0) & (F.col(score) < point(r)), r - 1).otherwise(r)
    buckets = rows.groupBy(*by, reached.alias("b")).agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    spread = ranges.withColumn("_step", step).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    return with_figures(_curve(buckets, by, spread.select(*by, "i", point(F.col("i")).alias("threshold"))), guarded=False)


def range_sweep(scores: DataFrame, by: list[str], positive: Column, score: str = "sim", points: int = 200) -> DataFrame:
    """Sweep over `points` thresholds from the least to the largest score; figures without a divisor are null."""
    ranges = scores.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.lit(points).alias("n"))
    return _spaced_sweep(scores, by, positive, score, ranges)


def overlap_sweep(scores: DataFrame, by: list[str], positive: Column, score: str = "sim", per_unit: float = 10.0) -> DataFrame:
    """Sweep over the range where positive and negative scores overlap, int(range * per_unit) thresholds; none if they hardly overlap."""
    ends = scores.withColumn("_y", positive).groupBy(*by).agg(
        F.min(F.when(F.col("_y"), F.col(score))).alias("p0"), F.max(F.when(F.col("_y"), F.col(score))).alias("p1"),
        F.min(F.when(~F.col("_y"), F.col(score))).alias("n0"), F.max(F.when(~F.col("_y"), F.col(score))).alias("n1"),
    )
    ends = ends.where("p0 is not null and n0 is not null").select(*by, F.greatest("p0", "n0").alias("lo"), F.least("p1", "n1").alias("hi"))
    ranges = ends.withColumn("n", F.greatest(((F.col("hi") - F.col("lo")) * per_unit).cast("int"), F.lit(0)))
    return _spaced_sweep(scores, by, positive, score, ranges)


def best_or_zero(curve: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """(by, threshold, f1, precision, recall) of the best point, zeros for a group in which nothing is above 0."""
    best = best_point(curve, by).where("f1 > 0")
    figures = ["threshold", "f1", "precision", "recall"]
    return groups.select(*by).join(best, by, "left").select(*by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in figures])


def hyper_grid(spark, scale: tuple[float, float], steps: tuple[int, int]) -> DataFrame:
    """(bi, ai, beta, alpha): i * scale / steps + 0.01 of either."""
    def axis(name: str, size: float, n: int) -> DataFrame:
        return spark.range(n).select(F.col("id").cast("int").alias(f"{name[0]}i"), (F.col("id") * F.lit(float(size)) / F.lit(float(n)) + F.lit(0.01)).alias(name))

    return axis("beta", scale[0], steps[0]).crossJoin(axis("alpha", scale[1], steps[1]))


def best_setting(figures: DataFrame) -> DataFrame:
    """(bi, ai, f1) of the largest mean F1; of equal ones the first, beta before alpha."""
    return figures.agg(F.max_by(F.struct("bi", "ai", "f1"), F.struct("f1", -F.col("bi"), -F.col("ai"))).alias("_b")).select("_b.*")
