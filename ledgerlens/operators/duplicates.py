"""Duplicate records as cases: exact matches and probable ones, joined into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.scratch import discard, written
from . import cases
from .graph import components
from .linkage import linked

POLICY_CLAUSE = "SG-PP-4.4"


def exact_edges(tx: DataFrame) -> DataFrame:
    """(a, b) from the first row of each vendor, amount and invoice number, case and blanks aside, to each other row of it. Rows without an invoice number match none."""
    rows = tx.where("invoice_no is not null and vendor_key is not null and amount is not null").select("row_id", "vendor_key", "amount", F.lower(F.trim("invoice_no")).alias("invoice"))
    # Rows are shuffled once. They are sorted, and the first is carried along, so no group is held in memory.
    w = Window.partitionBy("vendor_key", "amount", "invoice").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.first("row_id").over(w).alias("a"), F.col("row_id").alias("b")).where("a <> b")


def evidence(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """a, b, stage, probability of each pair that counts; a pair that is both exact and probable is exact."""
    exact = exact_edges(tx).select("a", "b", F.lit("exact").alias("stage"), F.lit(1.0).alias("probability"))
    likely = linked(tx, t, t.match_posterior).select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"), F.lit("probabilistic").alias("stage"), F.round("posterior", 4).alias("probability"))
    return exact.unionByName(likely.join(exact.select("a", "b"), ["a", "b"], "left_anti"))


def duplicate_cases(tx: DataFrame, pairs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A case for each group of rows joined by pairs: everything after the first row, by date and row_id, is at risk. score: the best pair's probability; stages: how its pairs were found."""
    pairs = written(pairs, "pairs")
    root = components(pairs)
    # Each step is stored, so that its shuffle files go before the next: of all that was shuffled the largest step is left.
    found = written(pairs.join(root.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.max("probability").alias("score"), F.array_sort(F.collect_set("stage")).alias("stages"), F.count("*").alias("n_pairs")), "found")
    discard(pairs)
    rows = written(root.join(tx.select(F.col("row_id").alias("id"), "txn_date", "vendor_key", F.col("amount").cast("decimal(18,2)").alias("amount")), "id"), "grouped")
    discard(root)
    # Few groups have many rows, so rows are shuffled as they are, narrower than what is summed of them; a group's list of rows is part of the case itself.
    first = F.min(F.struct("txn_date", "id", "amount", "vendor_key")).alias("first")
    groups = rows.repartition("root").groupBy("root").agg(F.collect_list("id").alias("row_ids"), F.sum("amount").alias("total"), first)
    groups = groups.select("root", "row_ids", "total", F.col("first.amount").alias("own"), "first.vendor_key", F.col("first.id").alias("original_row_id"))
    both = groups.join(found, "root").withColumn("at_risk", (F.col("total") - F.col("own")).cast("double"))
    return cases.build(both, "d1", "duplicate", t, {"policy_clause": F.lit(POLICY_CLAUSE), "original_row_id": F.col("original_row_id"), "stages": F.array_join("stages", ","), "n_pairs": F.col("n_pairs")})


def detect(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return duplicate_cases(tx, evidence(tx, t), t)
