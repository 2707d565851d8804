"""The operators as queries over the whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annulus_kmeans, block_topk, byte_bpe, ctw, exact_dedup, fill_middle, language_id, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, token_files
from .common import documents
from .vectors import embeddings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": lambda spark, sf_dir: ngram_join.op1(documents(spark, sf_dir)),
        "op2_language_id": lambda spark, sf_dir: language_id.op2(documents(spark, sf_dir)),
        "op3_source_mixing": lambda spark, sf_dir: mixing.op3(documents(spark, sf_dir)),
        "op4_suffix_dedup": lambda spark, sf_dir: suffix_dedup.op4(documents(spark, sf_dir)),
        "op5_ctw_scoring": lambda spark, sf_dir: ctw.op5(documents(spark, sf_dir)),
        "op6_license_scan": lambda spark, sf_dir: license_scan.license_scan(documents(spark, sf_dir)),
        "op7_exact_dedup": lambda spark, sf_dir: exact_dedup.op7(documents(spark, sf_dir)),
        "op8_token_files": lambda spark, sf_dir: token_files.token_files(documents(spark, sf_dir)),
        "op9_byte_bpe": lambda spark, sf_dir: byte_bpe.byte_bpe(documents(spark, sf_dir)),
        "op10_quality_rules": lambda spark, sf_dir: quality_rules.op10(documents(spark, sf_dir)),
        "op11_centroid_clustering": lambda spark, sf_dir: annulus_kmeans.op11(embeddings(spark, sf_dir)),
        "op12_fill_in_middle": lambda spark, sf_dir: fill_middle.op12(documents(spark, sf_dir)),
        "op13_exact_topk": lambda spark, sf_dir: block_topk.op13(embeddings(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op11_centroid_clustering": annulus_kmeans.oracle(), "op12_fill_in_middle": fill_middle.ORACLE, "op13_exact_topk": block_topk.ORACLE,
    }
