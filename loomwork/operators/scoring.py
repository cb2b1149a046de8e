"""Scoring items against class prototypes and few-shot caches.

Every item gets all its class scores as one array, next to a one-row broadcast of the prototypes. Softmax, argmax, top-k and
cache logits are then array functions of that row: nothing is shuffled, however many items there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.vectors import dot
from loomwork.operators.bounded import as_one_row


def class_scores(items: DataFrame, prototypes: DataFrame, vec: str = "vec", scale: float = 1.0, out: str = "scores") -> DataFrame:
    """`items` with `out`: array<struct<cls, sim>> in order of cls. prototypes: (cls, vec), a bounded table of unit vectors."""
    one = as_one_row(prototypes.select("cls", F.col("vec").alias("_p")), "cls", "_classes")
    found = F.transform("_classes", lambda c: F.struct(c["cls"].alias("cls"), (dot(F.col(vec), c["_p"]) * F.lit(scale) if scale != 1 else dot(F.col(vec), c["_p"])).alias("sim")))
    return items.crossJoin(one).withColumn(out, found).drop("_classes")


def long_scores(scored: DataFrame, *keep: str, scores: str = "scores") -> DataFrame:
    """One row for each item and class: the kept columns, cls and sim."""
    return scored.select(*keep, F.inline(scores))


def best_class(scores: str = "scores") -> Column:
    """The class of the largest score; of equal ones the first."""
    ranked = F.transform(scores, lambda s: F.struct(s["sim"].alias("sim"), (-s["cls"]).alias("minus")))
    return -F.array_max(ranked)["minus"]


def top_classes(k: int, scores: str = "scores") -> Column:
    """The k best classes, best first; ties go to the lower class."""
    ranked = F.transform(scores, lambda s: F.struct((-s["sim"]).alias("sim"), s["cls"].alias("cls")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["cls"])


def with_softmax(scored: DataFrame, scale: float = 100.0, scores: str = "scores", out: str = "probs") -> DataFrame:
    """`scored` with `out`: array<struct<cls, prob>>."""
    top = F.array_max(F.transform(scores, lambda s: s["sim"]))
    raised = F.zip_with(scores, F.array_repeat(top, F.size(scores)), lambda s, m: F.struct(s["cls"].alias("cls"), F.exp((s["sim"] - m) * F.lit(scale)).alias("e")))
    total = F.aggregate("_raised", F.lit(0.0), lambda a, s: a + s["e"])
    shares = F.zip_with("_raised", F.array_repeat(total, F.size("_raised")), lambda s, t: F.struct(s["cls"].alias("cls"), (s["e"] / t).alias("prob")))
    return scored.withColumn("_raised", raised).withColumn(out, shares).drop("_raised")


def with_affinities(items: DataFrame, cache: DataFrame, vec: str = "vec", out: str = "affinities") -> DataFrame:
    """`items` with their dot products with all cache keys: array<struct<label, a>> in order of key_id. cache: (key_id, vec, label), bounded."""
    one = as_one_row(cache.select("key_id", F.col("vec").alias("_k"), "label"), "key_id", "_keys")
    found = F.transform("_keys", lambda k: F.struct(k["label"].alias("label"), dot(F.col(vec), k["_k"]).alias("a")))
    return items.crossJoin(one).withColumn(out, found).drop("_keys")


def cache_logits(classes: Column, beta: Column, affinities: str = "affinities") -> Column:
    """10 * sum of exp(-(beta - beta * affinity)) over the keys of each class: array<struct<cls, cache>>; 0 for a class without keys."""
    heat = F.transform(affinities, lambda k: F.struct(k["label"].alias("label"), F.exp(-(beta - beta * k["a"])).alias("e")))

    def total(cls: Column, rows: Column) -> Column:
        return F.aggregate(F.filter(rows, lambda k: k["label"] == cls), F.lit(0.0), lambda s, k: s + k["e"]) * 10

    return F.zip_with(classes, F.array_repeat(heat, F.size(classes)), lambda c, rows: F.struct(c.alias("cls"), total(c, rows).alias("cache")))


def combined_logits(alpha: Column, cached: Column, scores: str = "scores", scale: float = 100.0) -> Column:
    """scale * similarity + alpha * cache logit, as array<struct<cls, sim>>."""
    return F.zip_with(scores, cached, lambda s, c: F.struct(s["cls"].alias("cls"), (s["sim"] * F.lit(scale) + alpha * c["cache"]).alias("sim")))
