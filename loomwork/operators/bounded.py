"""Small tables by contract: classes, prototypes, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def bounded(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """`df` as a table that may be broadcast: its rows are fetched once, and more than `max_rows` are an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; this side has to be small")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def as_one_row(df: DataFrame, order: str, out: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """A bounded table as one row with one array of structs, in order."""
    small = bounded(df, max_rows)
    others = [c for c in df.columns if c != order]
    return F.broadcast(small.agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias(out)))
