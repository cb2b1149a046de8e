"""Scans of class-organised image folders, read-through feature tables and decoding."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.paths import CLASS_ENDINGS, IMAGE_ENDINGS, ending, folder
from loomwork.operators.lookups import every_group
from loomwork.storage import exists

FILE_SCHEMA = "path string, length long, label string"


def image_files(
    spark: SparkSession, root: str, endings: tuple[str, ...] | None = None, recursive: bool = True, content: bool = False, is_valid_file: Column | None = None
) -> DataFrame:
    """(path, length, label[, content]) of the image files below a folder; none if it doesn't exist. Contents are only read if asked for.

    Which files count is said by their endings (by default those of images, of class folders that aren't searched further) or by a condition on path and length, not by both.
    """
    if endings is not None and is_valid_file is not None:
        raise ValueError("either endings or is_valid_file")
    extra = ", content binary" if content else ""
    if not exists(spark, root):
        return spark.createDataFrame([], FILE_SCHEMA + extra)
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).load(root) if recursive else reader.load(f"{root}/*/*")
    found = found.where(ending(F.col("path")).isin(*(endings or (IMAGE_ENDINGS if recursive else CLASS_ENDINGS))) if is_valid_file is None else is_valid_file)
    if not recursive:  # the pattern also lists what lies in folders of the second level
        found = found.where(F.col("path").rlike("\\Q" + root.rstrip("/").split(":", 1)[-1] + "\\E/[^/]+/[^/]+$"))
    return found.select("path", "length", folder(F.col("path")).alias("label"), *(["content"] if content else []))


def visible(files: DataFrame) -> DataFrame:
    """Without folders whose names begin with a dot."""
    return files.where(~F.col("label").startswith("."))


def empty_files(files: DataFrame) -> DataFrame:
    return files.where("length = 0")


def class_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, idx): the distinct labels in order, numbered from 0; a small table."""
    distinct = labels.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("idx", F.row_number().over(Window.orderBy(label)) - 1)


def mapped(files: DataFrame, class_map: DataFrame, allow_empty: bool = False) -> DataFrame:
    """`files` with the `target` classes of their folders (class_map: target, folder). Unless allowed, a target without files is an error when the result is read."""
    found = files.join(F.broadcast(class_map), files["label"] == class_map["folder"]).drop("folder")
    return found if allow_empty else every_group(found, class_map, "target", "files")


def split_files(spark: SparkSession, dataset: str, split: str, **options) -> DataFrame:
    """The image files of a dataset's split, from its images/train or images/val; "test" is "val"."""
    folders = {"train": "train", "val": "val", "test": "val"}
    if split not in folders:
        raise ValueError(f"unknown split {split}; there are {sorted(folders)}")
    return image_files(spark, f"{dataset.rstrip('/')}/images/{folders[split]}", **options)


def paired_folders(class_map: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(folder, target) of the map whose folder has files on the left and whose target has files on the right; other pairs are skipped."""
    pairs = class_map.select("folder", "target").distinct()
    pairs = pairs.join(left.select(F.col("label").alias("folder")).distinct(), "folder", "left_semi")
    return pairs.join(right.select(F.col("label").alias("target")).distinct(), "target", "left_semi").select("folder", "target")


def unmapped_folders(files: DataFrame, class_map: DataFrame) -> DataFrame:
    """(label, files): the folders that the map doesn't know, with their number of files."""
    return files.join(F.broadcast(class_map.select(F.col("folder").alias("label")).distinct()), "label", "left_anti").groupBy("label").agg(F.count("*").alias("files"))


def first_listed(files: DataFrame, lists: DataFrame, path: str = "path") -> DataFrame:
    """`files` with `category`: the first class (by its place `turn`) in whose list the path stands; null if it is in none. lists: (turn, category, listed)."""
    first = lists.groupBy(F.col("listed").alias("_l")).agg(F.min_by("category", "turn").alias("category"))
    return files.join(first, F.col(path) == F.col("_l"), "left").drop("_l")


def read_through(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; if there is none, it is computed and written first."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def decoded(files: DataFrame, size: int = 224) -> DataFrame:
    """(path, label, pixels binary of size x size RGB). An image that can't be read gets the label `error`. Needs Pillow."""
    try:
        from PIL import Image  # noqa: F401
    except ImportError as e:
        raise ImportError("decoding images needs Pillow") from e

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from PIL import Image

        for batch in batches:
            rows = []
            for path, label, content in zip(batch["path"], batch["label"], batch["content"], strict=True):
                try:
                    image = Image.open(io.BytesIO(content))
                    if image.mode in ("RGBA", "LA", "P"):  # onto white
                        image = image.convert("RGBA")
                        image = Image.alpha_composite(Image.new("RGBA", image.size, "white"), image)
                    rows.append((path, label, np.asarray(image.convert("RGB").resize((size, size))).tobytes()))
                except Exception:
                    rows.append((path, "error", None))
            yield pd.DataFrame(rows, columns=["path", "label", "pixels"])

    return files.select("path", "label", "content").mapInPandas(decode, "path string, label string, pixels binary")


def readable(rows: DataFrame) -> DataFrame:
    """Without the rows that couldn't be read."""
    return rows.where(F.col("label") != "error")


def encoded(rows: DataFrame, encode: Callable[[pd.DataFrame], list], out: str = "vec") -> DataFrame:
    """`rows` with vectors by any encoder, a function from a batch of rows to its vectors."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: list(encode(batch))})[[*names, out]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{out}` array<double>")
