"""Incremental ingestion: files that arrive are read as a stream, and only contents that the feature table hasn't yet are added to it.

Each micro-batch writes a folder of its own in the table, so a batch that is repeated after a broken run replaces what it wrote before and
never adds it twice. A content's first arrival counts: it is found by joining the batch's hashes (the first row of each, by the order column)
with the hashes of earlier batches, of which only that column is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomwork.storage import exists


def feature_table(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """What has been ingested; empty before the first batch. `batch` is the number of the batch that a row came with."""
    whole = StructType([*schema.fields]).add("content_hash", "string").add("batch", "long")
    return spark.read.schema(whole).parquet(table) if exists(spark, table) else spark.createDataFrame([], whole)


def _added(table: str, content: Column, order: str, features: Callable[[DataFrame], DataFrame] | None, schema: StructType) -> Callable[[DataFrame, int], None]:
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("content_hash", F.md5(content)).where(F.col("content_hash").isNotNull())
        first = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*batch.columns), order).alias("_row")).select("_row.*", "content_hash")
        known = feature_table(spark, table, schema).where(F.col("batch") != number).select("content_hash")
        new = first.join(known, "content_hash", "left_anti").select(*batch.columns, "content_hash")
        (features(new) if features else new).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return add


def ingest(
    spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, content: Column, order: str,
    features: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000, wait: bool = True,
) -> StreamingQuery:
    """Take in the Parquet files at `source` (a folder or a pattern) that the checkpoint doesn't know yet, in batches, then stop.

    content: what makes two rows the same (rows whose content is null are left out); order: which of equal rows in a batch is kept, the least.
    `features` adds columns to new rows only (an encoder's vectors, say); the table then has these too.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    adding = _added(table, content, order, features, schema)
    query = stream.writeStream.foreachBatch(adding).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
