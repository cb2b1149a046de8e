"""Writers: samples as JSON, metrics as CSV, features as Parquet, manifests instead of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.bounded import bounded


def write_samples(samples: DataFrame, path: str, with_metadata: bool = False) -> None:
    """JSON lines, one sample each; `metadata` is left out unless asked for."""
    (samples if with_metadata else samples.drop("metadata")).write.mode("overwrite").json(path)


def samples_array(samples: DataFrame, max_rows: int = 10_000, indent: bool = True) -> str:
    """A bounded set of samples as one JSON array."""
    one = bounded(samples, max_rows).agg(F.to_json(F.collect_list(F.struct(*samples.columns)), {"pretty": str(indent).lower()}).alias("j"))
    return one.first()["j"]


def fixed_places(df: DataFrame, places: int) -> DataFrame:
    """Doubles as text with so many places."""
    return df.select(*[F.format_string(f"%.{places}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, by: str | None = None, places: int = 3) -> None:
    """CSV with a header, in a folder for each value of `by`."""
    writer = fixed_places(df, places).write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_features(features: DataFrame, path: str, by: str | None = "label") -> None:
    """Parquet, in a folder for each class, so that later reads of some classes prune the rest."""
    writer = features.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def rename_manifest(files: DataFrame, old: str, new: Column) -> DataFrame:
    """(old_path, new_path, collides): what would be renamed; a new path that two files would get is marked."""
    manifest = files.select(F.col(old).alias("old_path"), new.alias("new_path"))
    return manifest.withColumn("collides", F.count("*").over(Window.partitionBy("new_path")) > 1)
