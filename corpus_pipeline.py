"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`; a stage that edits texts sets n_chars anew. Nulls, empty texts and repeated rows
are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard_forest, packing, prefix_trees, secret_scan, toxicity
from loomwork.llm.queries import tokenizer_path
from loomwork.llm.shared import set_aside
from loomwork.storage import stored


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, restore = set_aside(docs)
    return restore(toxicity.score(inner, model, out="_toxicity").where(F.col("_toxicity") < 0.5))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_forest.one_of_each(docs)


def without_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; documents left without a word go."""
    return _recounted(prefix_trees.without_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _recounted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 tokens."""
    return packing.shortest_pack_first(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("substring dedup", without_shared_passages),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Trained scores and tokenizers can't be said in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
