"""From documents to tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import byte_bpe
from ledgerlens.llm.common import documents, scratch_path
from ledgerlens.llm.exact_dedup import exact_dedup, with_digest
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.ngram_join import ngram_join
from ledgerlens.llm.quality_rules import quality_rules

MARK = "_ledgerlens_"
#: Pieces that a worker remembers while encoding; fewer than the operator does alone, as the other stages' workers share the executor.
PIECES = 1 << 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null or empty text fails; columns stay as they are; repeated rows are judged alike."""
    return quality_rules(docs, prefix=MARK).where(F.col(f"{MARK}kept")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the row that the operator keeps. Of rows with one doc_id and text one stays; a null doc_id counts as a value; null text counts as empty."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(f"{MARK}id"), F.col("text_sha256").alias(f"{MARK}sha"), F.col("text_hash").alias(f"{MARK}hash"))
    rows = with_digest(docs, f"{MARK}digest")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{MARK}id")) & (F.col(f"{MARK}digest") == F.col(f"{MARK}sha")) & (F.col(f"{MARK}digest_text") == F.col(f"{MARK}hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", f"{MARK}digest"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates. Documents without words or with a null doc_id are in no class and stay; of a doc_id with several texts only those in a class of a lesser doc_id go."""
    gone = ngram_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(f"{MARK}id"), F.col("text_hash").alias(f"{MARK}hash")).distinct()
    same = (docs["doc_id"].cast("long") == gone[f"{MARK}id"]) & (F.xxhash64(docs["text"].cast("string")) == gone[f"{MARK}hash"])
    return docs.join(gone, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. A null doc_id and a null source count as values."""
    plan = mix(docs).groupBy(F.col("doc_id").alias(f"{MARK}id"), F.col("source").alias(f"{MARK}source")).agg(F.max("copies").alias(f"{MARK}copies")).where(F.col(f"{MARK}copies") > 0)
    taken = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(plan[f"{MARK}id"]) & docs["source"].cast("string").eqNullSafe(plan[f"{MARK}source"]))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), f"{MARK}copies")).alias(f"{MARK}copy")).drop(f"{MARK}copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row. Null text has no tokens."""
    return byte_bpe(docs, cache=PIECES, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixing),
    ("byte-level BPE", tokens),
]
#: SQL has no suffix arrays and no BPE; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(path := scratch_path(spark, f"stage{i}"))
        docs = spark.read.parquet(path)
    return docs
