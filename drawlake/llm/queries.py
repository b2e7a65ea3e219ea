"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drawlake.llm import chat, importance, langid, minhash, mixing, nndescent, pieces, quality, secrets, sitetree, substrings, trie, webp


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(_read(spark, sf_dir, "pages"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(_read(spark, sf_dir, "conversations"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op7_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted_languages(_read(spark, sf_dir, "documents"))


def op10_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.text_media(_read(spark, sf_dir, "documents"))


def op11_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(_read(spark, sf_dir, "documents")).drop("text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_site_style_tree, op2_snapshot_collapse, op3_bbit_minhash, op4_hierarchical_mix, op5_compression_quality, op6_nn_descent, op7_piece_viterbi, op8_secret_scan, op9_language_id, op10_webp_lossless, op11_super_kmers, op12_prefix_trie, op13_importance_sample)}

ORACLES: dict[str, str] = {"op2_snapshot_collapse": chat.ORACLE_SQL, "op4_hierarchical_mix": mixing.oracle_sql(), "op11_super_kmers": substrings.ORACLE_SQL, "op12_prefix_trie": trie.ORACLE_SQL, "op13_importance_sample": importance.ORACLE_SQL}
