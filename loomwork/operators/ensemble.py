"""Two models on one corpus: unions of their passes, and cascades in which a costly second look follows a cheap first one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomwork.operators.metrics import with_figures


def passes(scores: DataFrame, thresholds: DataFrame, by: str, name: str, keep: list[str], prefix: str, score: str = "sim") -> DataFrame:
    """One row for each (by, name): the last row's score and whether it passes the threshold of its class; repeated names count once."""
    marked = scores.join(F.broadcast(thresholds.select(by, "threshold")), by)
    last = F.max_by(F.struct(F.col(score).alias("sim"), (F.col(score) >= F.col("threshold")).alias("pass"), F.col("path")), "path")
    grouped = marked.groupBy(by, name, *keep).agg(last.alias("_l"))
    return grouped.select(by, name, *keep, F.col("_l.sim").alias(f"{prefix}_sim"), F.col("_l.pass").alias(f"{prefix}_pass"), F.col("_l.path").alias(f"{prefix}_path"))


def union_of(one: DataFrame, two: DataFrame, keys: list[str], a: str = "en", b: str = "cn") -> DataFrame:
    """Both models' files by name; one that a model doesn't know didn't pass it. The first model's path is preferred."""
    both = one.join(two, keys, "full_outer")
    return both.select(
        *keys, f"{a}_sim", f"{b}_sim", *[F.coalesce(f"{m}_pass", F.lit(False)).alias(f"{m}_pass") for m in (a, b)],
        F.coalesce(f"{a}_path", f"{b}_path").alias("source_path"),
    ).withColumn("either", F.col(f"{a}_pass") | F.col(f"{b}_pass"))


def union_metrics(union: DataFrame, by: str, positive: Column) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of passing either model."""
    rows = union.withColumn("_y", positive)
    counts = rows.groupBy(by).agg(F.count_if(F.col("_y") & F.col("either")).alias("tp"), F.count_if(~F.col("_y") & F.col("either")).alias("fp"), F.count_if(F.col("_y") & ~F.col("either")).alias("fn"))
    return with_figures(counts)


def union_counts(union: DataFrame, by: str, a: str = "en", b: str = "cn") -> DataFrame:
    """How many files each model knows and passes, both pass, and either passes."""
    x, y = F.col(f"{a}_pass"), F.col(f"{b}_pass")
    return union.groupBy(by).agg(
        F.count(f"{a}_sim").alias(f"{a}_total"), F.count(f"{b}_sim").alias(f"{b}_total"), F.count_if(x).alias(f"{a}_correct"),
        F.count_if(y).alias(f"{b}_correct"), F.count_if(x & y).alias("both"), F.count_if(x | y).alias("union_total"),
    )


def or_predictions(one: DataFrame, two: DataFrame, key: list[str], thresholds: tuple[Column, Column], score: str = "sim") -> DataFrame:
    """(key, pred): 0 (positive) if either model's score reaches its threshold, else 1. Rows meet by key, not by position."""
    a = one.select(*key, F.when(F.col(score) < thresholds[0], 1).otherwise(0).alias("_a"))
    b = two.select(*key, F.when(F.col(score) < thresholds[1], 1).otherwise(0).alias("_b"))
    return a.join(b, key).select(*key, F.least("_a", "_b").alias("pred"))


def cascade(rows: DataFrame, key: str, cheap: Column, verdict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with `first` and `final`: rows that pass the cheap test are shown to `verdict`, which gives (key, yes); a no demotes them.

    The costly step is a plan of its own over the passing rows, as the order of two tests in one condition isn't kept.
    """
    marked = rows.withColumn("first", cheap)
    judged = verdict(marked.where("first")).select(F.col(key).alias("_k"), "yes")
    final = F.col("first") & F.coalesce("yes", F.lit(False))
    return marked.join(judged, F.col(key) == F.col("_k"), "left").withColumn("final", final).drop("_k", "yes")


def _counts() -> dict[str, Column]:
    return {"seen": F.count("*"), "first": F.count_if("first"), "confirmed": F.count_if("final"), "demoted": F.count_if(F.col("first") & ~F.col("final"))}


def cascade_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, seen, first, confirmed, demoted) of a cascade's rows: how many passed the cheap test, and what the costly one made of them."""
    return rows.groupBy(*by).agg(*[c.alias(name) for name, c in _counts().items()])


def observed_cascade(
    rows: DataFrame, key: str, cheap: Callable[[pd.DataFrame], np.ndarray], costly: Callable[[pd.DataFrame], np.ndarray], inputs: list[str], name: str = "cascade"
) -> tuple[DataFrame, Observation]:
    """(key, first, final) of a cascade of two functions of a batch of `inputs`, and an observation: once the result has been written or read
    in full, it has the cascade's counts and the seconds that either stage took, summed over all tasks. All come from that very run.

    The costly function gets only the rows of a batch that pass the cheap one. A missing answer is a no.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            at = [time.perf_counter()]
            first = np.asarray(pd.Series(cheap(batch[inputs])).fillna(False), bool)
            at.append(time.perf_counter())
            final = np.zeros(len(batch), bool)
            if first.any():
                final[first] = np.asarray(pd.Series(costly(batch.loc[first, inputs])).fillna(False), bool)
            at.append(time.perf_counter())
            each = {f"_{n}": (b - a) / max(len(batch), 1) for n, a, b in zip(("first", "second"), at[:-1], at[1:], strict=True)}
            yield pd.DataFrame({key: batch[key], "first": first, "final": final, **each})

    observation = Observation(name)
    columns = list(dict.fromkeys([key, *inputs]))
    judged = rows.select(*columns).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, first boolean, final boolean, _first double, _second double")
    seconds = {"first_seconds": F.sum("_first"), "second_seconds": F.sum("_second")}
    observed = judged.observe(observation, *[c.alias(n) for n, c in (_counts() | seconds).items()])
    return observed.select(key, "first", "final"), observation


def model_verdict(load: Callable[[], Callable[..., np.ndarray]], inputs: list[str], key: str, batch_size: int = 64, shapes: list[list[int] | None] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A cascade's verdict by a pluggable model: `load` is called once in each worker and gives a function from arrays of the inputs to one
    number for each row (above 0.5: yes)."""

    def verdict(rows: DataFrame) -> DataFrame:
        predict = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=shapes)
        return rows.select(F.col(key), (predict(*[F.col(c) for c in inputs]) > 0.5).alias("yes"))

    return verdict
