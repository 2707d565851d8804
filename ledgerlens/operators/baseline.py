"""The rule baseline: four rules, score 1 each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from . import cases


def money(c: str) -> F.Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def duplicates(tx: DataFrame, by_invoice: bool = True) -> DataFrame:
    """Rows alike in vendor name, invoice and amount. by_invoice=False leaves the invoice out."""
    keys = [F.lower(F.trim("vendor_name")).alias("name"), "amount", *(["invoice_no"] if by_invoice else [])]
    found = tx.where("invoice_no is not null") if by_invoice else tx
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"), F.count("*").alias("n"), F.min("vendor_key").alias("vendor_key")).where("n > 1").withColumns({"at_risk": F.col("amount") * (F.col("n") - 1), "score": F.lit(1.0)})


def near_threshold(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return tx.where((F.col("amount") >= t.near_share * t.approval) & (F.col("amount") < t.approval)).select("row_id", "vendor_key", "amount", F.array("row_id").alias("row_ids"), F.lit(1.0).alias("score"), F.col("amount").alias("at_risk"))


def inflation(tx: DataFrame) -> DataFrame:
    """Unit prices over twice their category's mean."""
    priced = tx.where("unit_price is not null and item_category is not null")
    norms = priced.groupBy("item_category").agg(F.avg("unit_price").alias("mean_price"), F.count("*").alias("n")).where("n >= 2").drop("n")
    return priced.join(norms, "item_category").where("unit_price > 2 * mean_price").select("row_id", "vendor_key", "item_category", "unit_price", "mean_price", F.array("row_id").alias("row_ids"), F.lit(1.0).alias("score"), ((F.col("unit_price") - F.col("mean_price")) * F.coalesce("quantity", F.lit(1.0))).alias("at_risk"))


def round_vendors(tx: DataFrame, unit: int = DEFAULT.round_unit, share: float = 0.5, least: int = 10) -> DataFrame:
    even = F.col("amount") % unit == 0
    return tx.groupBy("vendor_key").agg(F.count("*").alias("n"), F.count_if(even).alias("n_round"), F.coalesce(F.sum(F.when(even, F.col("amount").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias("at_risk")).where((F.col("n") >= least) & (F.col("n_round") / F.col("n") >= share))


def detect(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Cases of all four rules. A vendor's case holds the vendor's round rows."""
    even = tx.where(F.col("amount") % t.round_unit == 0).groupBy("vendor_key").agg(F.collect_list("row_id").alias("row_ids"))
    found = (
        ("duplicate", "exact duplicate", duplicates(tx)), ("split", "near threshold", near_threshold(tx, t)), ("inflation", "over twice the mean", inflation(tx)),
        ("vendor_flag", "round amounts", round_vendors(tx, t.round_unit).join(even, "vendor_key").withColumn("score", F.lit(1.0))),
    )
    out = None
    for kind, rule, df in found:
        one = cases.build(df, "baseline", kind, t, {"rule": F.lit(rule)})
        out = one if out is None else out.unionByName(one)
    return out
