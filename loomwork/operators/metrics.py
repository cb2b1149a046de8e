"""Confusion counts and the figures that follow from them. Rows are reduced to counts by (target, prediction) in one shuffle; all else is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ratios


def confusion_matrix(predicted: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """(target, pred, n)."""
    return predicted.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def one_vs_rest(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, tn) for every class of `classes` (cls), also those that never occur."""
    at, want = F.col("pred") == F.col("cls"), F.col("target") == F.col("cls")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    cells = classes.select("cls").join(F.broadcast(matrix), F.lit(True), "left")
    return cells.groupBy("cls").agg(total(at & want).alias("tp"), total(at & ~want).alias("fp"), total(~at & want).alias("fn"), total(~at & ~want).alias("tn"))


def binary_counts(rows: DataFrame, by: list[str], positive: Column, predicted: Column) -> DataFrame:
    """(by, tp, fp, fn, tn) of yes/no predictions."""
    rows = rows.select(*by, positive.alias("_y"), predicted.alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    return rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def with_figures(counts: DataFrame, guarded: bool = True) -> DataFrame:
    return counts.withColumns({"precision": ratios.precision(guarded), "recall": ratios.recall(guarded), "f1": ratios.f1(guarded)})


def with_average(figures: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The rows and one more, `Average`: the mean of each column (macro average)."""
    label = F.col(name).cast("string")
    mean = figures.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit("Average").alias(name), *columns)
    return figures.select(label.alias(name), *columns).unionByName(mean)


def macro_f1_percent(counts: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """100 times the mean smoothed F1 of all classes, absent ones too."""
    return counts.agg((F.avg(ratios.smoothed_f1(epsilon)) * 100).alias("macro_f1"))


def topk_accuracy(rows: DataFrame, top: Column, target: str, excluded: int | None = None) -> DataFrame:
    """(n, hits, accuracy percent): whether the target is among the classes of `top`; 0 if no row counts."""
    rows = rows.where(F.col(target) != excluded) if excluded is not None else rows
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.array_contains(top, F.col(target))).alias("hits"))
    return found.withColumn("accuracy", F.coalesce(F.try_divide(F.lit(100.0) * F.col("hits"), F.col("n")), F.lit(0.0)))


def classification_report(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, precision, recall, f1, support): each class, then accuracy, the macro and the support-weighted average."""
    counts = with_figures(one_vs_rest(matrix, classes)).withColumn("support", F.col("tp") + F.col("fn"))
    figures = ["precision", "recall", "f1"]
    each = counts.select(F.col("cls").cast("string").alias("name"), *figures, "support")
    whole = counts.agg(
        F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.sum("support")), F.lit(0.0)).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in figures],
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"w_{c}") for c in figures],
        F.sum("support").alias("support"),
    )
    lines = [F.struct(F.lit("accuracy").alias("name"), *[F.col("acc").alias(c) for c in figures], "support")]
    lines += [F.struct(F.lit(n).alias("name"), *[F.col(f"{n[0]}_{c}").alias(c) for c in figures], "support") for n in ("macro avg", "weighted avg")]
    return each.unionByName(whole.select(F.inline(F.array(*lines))))


def key_values(counts: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(name, metric, value): a row for each figure."""
    return counts.unpivot([name], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
