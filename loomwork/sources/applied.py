"""Manifests carried out: files copied, moved or deleted by tasks, with a log of what is done.

A manifest is split over tasks, which work on any store that pyarrow knows by its address (local and network disks, HDFS, object stores).
Every operation can be done twice without harm, as a task may be repeated or run in two places: a copy is written beside its
place and then renamed, a move whose source is gone and whose target is there is done, and so is a deletion of a file that isn't there.
What was done is written as a table, a folder for each run, and rows that stand in it as done aren't begun again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.storage import exists

ACTIONS = ("copy", "move", "delete")
LOG = "old_path string, new_path string, action string, status string, bytes long, error string"


def _carry_out(old: str, new: str | None, action: str) -> tuple[str, int]:
    """What became of one file, and its size: done, or already (an earlier attempt did it). Raises FileNotFoundError if there is nothing to work on."""
    from pyarrow import fs

    def place(path: str):
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    source, path = place(old)
    found = source.get_file_info(path)
    there = found.type == fs.FileType.File
    if action == "delete":
        if not there:
            return "already", 0
        source.delete_file(path)
        return "done", found.size
    target, goal = place(new)
    reached = target.get_file_info(goal)
    if reached.type == fs.FileType.File and (not there or action == "copy" and reached.size == found.size):
        return "already", reached.size
    if not there:
        raise FileNotFoundError(old)
    if reached.type == fs.FileType.File and action == "move" and reached.size != found.size:
        raise FileExistsError(new)
    target.create_dir(goal.rsplit("/", 1)[0], recursive=True)
    beside = f"{goal}.{uuid.uuid4().hex}.part"
    fs.copy_files(path, beside, source_filesystem=source, destination_filesystem=target)
    target.move(beside, goal)
    if action == "move":
        source.delete_file(path)
    return "done", found.size


def applied_log(spark: SparkSession, log: str) -> DataFrame:
    """(old_path, new_path, action, status, bytes, error) of all runs so far; the copied-files list is this with action = 'copy'."""
    return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(log) if exists(spark, log) else spark.createDataFrame([], LOG)


def apply_manifest(manifest: DataFrame, action: str, log: str, dry_run: bool = True) -> DataFrame:
    """Carry out a manifest (old_path, new_path[, collides]; `path` alone for deletions) and return this run's log.

    A manifest in which two files would get one new path is refused before anything is touched. With dry_run (the default) nothing is
    touched and every row that isn't done yet has the status `would`. A row that fails is `failed` with its error and is tried again by the next run.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}; there are {ACTIONS}")
    spark = manifest.sparkSession
    old = "old_path" if "old_path" in manifest.columns else "path"
    new = F.lit(None).cast("string") if action == "delete" else F.col("new_path")
    rows = manifest.select(F.col(old).alias("old_path"), new.alias("new_path")).distinct()
    if action != "delete":
        twice = rows.groupBy("new_path").count().where("count > 1").select("new_path").limit(5).collect()
        if twice:
            raise ValueError(f"several files would get one name: {sorted(r[0] for r in twice)}")
    done = applied_log(spark, log).where(F.col("status").isin("done", "already") & (F.col("action") == action))
    done = done.select(F.col("old_path").alias("_o"), F.col("new_path").alias("_n")).distinct()
    rows = rows.join(done, F.col("old_path").eqNullSafe(F.col("_o")) & F.col("new_path").eqNullSafe(F.col("_n")), "left_anti")
    if dry_run:
        return rows.select("old_path", "new_path", F.lit(action).alias("action"), F.lit("would").alias("status"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("string").alias("error"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b in zip(batch["old_path"], batch["new_path"], strict=True):
                try:
                    found.append((a, b, action, *_carry_out(a, b, action), None))
                except Exception as e:
                    found.append((a, b, action, "failed", 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["old_path", "new_path", "action", "status", "bytes", "error"])

    run = f"{log.rstrip('/')}/run-{uuid.uuid4().hex}"
    rows.repartition(spark.sparkContext.defaultParallelism, "old_path").mapInPandas(work, LOG).write.parquet(run)
    return spark.read.schema(LOG).parquet(run)
