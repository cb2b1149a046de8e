"""Audits of assembled datasets: how many samples, and are they even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Even counts may differ by one sample from their mean.
SLACK = 1.001


def distribution(samples: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, n) of each pair, and with a null source each target's total."""
    return samples.groupingSets([[source, target], [target]], source, target).agg(F.count("*").alias("n"))


def repeated(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def question_balance(samples: DataFrame, category: str, classes: DataFrame) -> DataFrame:
    """(total, balanced): every class has as many samples as the others, but for one; an empty set is balanced."""
    counts = samples.groupBy(F.col(category).alias("cls")).agg(F.count("*").alias("n"))
    spine = classes.select("cls").join(counts, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    whole = samples.agg(F.count("*").alias("total"))
    facts = spine.agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high")).crossJoin(F.broadcast(whole))
    mean = F.col("total") / F.col("k")
    apart = F.greatest(F.col("high") - mean, mean - F.col("low"))
    # a total that the classes don't divide leaves a difference of up to one sample
    return facts.select("total", ((F.col("total") == 0) | (apart <= SLACK)).alias("balanced"))


def source_balance(samples: DataFrame, category: str, source: str, classes: DataFrame) -> DataFrame:
    """(question, total, balanced): the other classes are even among each question's sources; its own class mustn't be one."""
    known = classes.select("cls")
    seen = samples.join(F.broadcast(known.select(F.col("cls").alias(category))), category).join(F.broadcast(known.select(F.col("cls").alias(source))), source)
    counts = seen.groupBy(F.col(category).alias("question"), F.col(source).alias("src")).agg(F.count("*").alias("n"))
    spine = known.select(F.col("cls").alias("question")).crossJoin(F.broadcast(known.select(F.col("cls").alias("src"))))
    full = spine.join(counts, ["question", "src"], "left").select("question", "src", F.coalesce("n", F.lit(0)).alias("n"))
    other = F.col("question") != F.col("src")
    facts = full.groupBy("question").agg(F.sum("n").alias("total"), F.sum(F.when(~other, F.col("n")).otherwise(0)).alias("own"), F.count_if(other).alias("k"), F.min(F.when(other, F.col("n"))).alias("low"), F.max(F.when(other, F.col("n"))).alias("high"))
    mean = F.col("total") / F.col("k")
    return facts.select("question", "total", ((F.col("own") == 0) & (F.col("high") - mean <= SLACK) & (mean - F.col("low") <= SLACK)).alias("balanced"))


def smallest_class(sizes: DataFrame) -> int:
    """The size of the smallest class that isn't empty; none at all is an error."""
    low = sizes.where("n > 0").agg(F.min("n")).first()[0]
    if not low:
        raise ValueError("every class is empty")
    return low
