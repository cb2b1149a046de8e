"""Joins in which every row must find its partner: a missing one fails the query from inside the plan, without a job of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found_or_raise(found: Column, message: Column) -> Column:
    """True where `found` is, else an error. As a condition it can't be pruned with the columns that nobody reads."""
    return F.when(found, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def complete_lookup(rows: DataFrame, table: DataFrame, key: str, take: list[str], what: str = "key") -> DataFrame:
    """`rows` with the columns `take` of `table` (one row for each key); a key that the table hasn't, or a null one, is an error when its row is reached."""
    found = table.select(F.col(key).alias("_key"), F.lit(True).alias("_found"), *[F.col(c).alias(f"_take{i}") for i, c in enumerate(take)])
    joined = rows.join(found, F.col(key) == F.col("_key"), "left")
    message = F.concat(F.lit(f"no {what} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    whole = joined.where(_found_or_raise(F.coalesce("_found", F.lit(False)), message))
    return whole.select(*[F.col(c) for c in rows.columns], *[F.col(f"_take{i}").alias(c) for i, c in enumerate(take)])


def every_group(rows: DataFrame, groups: DataFrame, on: str, what: str = "rows") -> DataFrame:
    """`rows`; a group (of a small table) that has none is an error when the result is read.

    The groups without rows are a part of the result in which each row raises; no group is collected.
    """
    seen = rows.select(F.col(on).alias("_g")).distinct()
    met = groups.select(F.col(on).alias("_want")).distinct().join(seen, F.col("_want") == F.col("_g"), "left")
    # the message names both sides, so that the condition can't be moved to one side of the join
    message = F.concat(F.lit(f"no {what} for "), F.coalesce(F.col("_want").cast("string"), F.lit("null")), F.coalesce(F.col("_g").cast("string"), F.lit("")))
    nobody = met.where(F.when(F.col("_g").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    return rows.unionByName(nobody.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
