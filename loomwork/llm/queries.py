"""The registered queries of this subpackage, each over its whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard_forest, line_quality, mixing, packing, periodic_runs, phrases, pieces, prefix_trees, secret_scan, suffix_arrays, toxicity, voronoi, warc_fixity


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.jaccard_classes(_read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.suffix_array_digests(_read(spark, sf_dir, "documents"))


def op3_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records against a replica with planted faults."""
    records = warc_fixity.warc_records(_read(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.with_planted_faults(records))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_frequency_quality(_read(spark, sf_dir, "documents"))


def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shortest_pack_first(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_secret_entropy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op8_prefix_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trees.substring_digests(_read(spark, sf_dir, "documents"))


def op9_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.voronoi_topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_warc_merkle_audit": op3_warc_merkle_audit,
    "op4_toxicity": op4_toxicity,
    "op5_line_frequency_quality": op5_line_frequency_quality,
    "op6_shortest_pack_first": op6_shortest_pack_first,
    "op7_secret_entropy_scan": op7_secret_entropy_scan,
    "op8_prefix_suffix_tree_dedup": op8_prefix_suffix_tree_dedup,
    "op9_sentencepiece_offsets": op9_sentencepiece_offsets,
    "op10_voronoi_topk": op10_voronoi_topk,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_mix_to_weights": op12_mix_to_weights,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_warc_merkle_audit": warc_fixity.ORACLE_SQL,
    "op5_line_frequency_quality": line_quality.ORACLE_SQL,
    "op10_voronoi_topk": voronoi.ORACLE_SQL,
    "op11_phrase_collocations": phrases.ORACLE_SQL,
    "op12_mix_to_weights": mixing.ORACLE_SQL,
}
