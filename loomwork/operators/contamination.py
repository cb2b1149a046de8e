"""Which training texts contain which test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.bounded import bounded

WORDS = 4


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def contained(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text") -> DataFrame:
    """(doc_key, item_key) of all pairs where the item's text stands in the document's.

    An item's second to fifth words stand whole in a text that contains it, so an equi-join on the hash of four words finds the
    candidates, and `contains` decides. Items of fewer than six words are compared with every document; they have to be few.
    """
    items = items.where(F.col(text).isNotNull()).select(item_key, F.col(text).alias("_item"), _words(F.col(text)).alias("_w"))
    whole = items.where(F.size("_w") >= WORDS + 2).select(item_key, "_item", F.xxhash64(F.slice("_w", 2, WORDS)).alias("_g"))
    words = docs.where(F.col(text).isNotNull()).select(doc_key, text, _words(F.col(text)).alias("_w"))
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - WORDS + 1), lambda i: F.xxhash64(F.slice("_w", i, WORDS))))
    grams = words.where(F.size("_w") >= WORDS).select(doc_key, F.explode(windows).alias("_g"))
    pairs = grams.join(whole.select(item_key, "_g"), "_g").select(doc_key, item_key).distinct()
    checked = docs.select(doc_key, text).join(pairs, doc_key).join(whole.select(item_key, "_item"), item_key).where(F.col(text).contains(F.col("_item")))
    short = bounded(items.where(F.size("_w") < WORDS + 2).select(item_key, "_item"))
    direct = docs.select(doc_key, text).join(short, F.col(text).contains(F.col("_item")))
    return checked.select(doc_key, item_key).unionByName(direct.select(doc_key, item_key))
