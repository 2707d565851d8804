"""Price inflation by robust z-scores of log unit prices, with pooled controls for quantity and time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.stats import exact_medians, logistic
from ..sources.scratch import written
from . import cases

SCALE, FLOOR = 1.4826, 0.02
POLICY_CLAUSE = "SG-PP-6.3"


def eligible(tx: DataFrame) -> DataFrame:
    return tx.where("unit_price > 0 and item_category is not null and quantity > 0").withColumn("log_price", F.log("unit_price"))


def category_stats(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Exact median and MAD of the log price of each category of enough rows. rows: of eligible()."""
    medians = exact_medians(rows, "log_price", ["item_category"]).where(F.col("n") >= t.min_category)
    off = rows.join(medians.drop("n"), "item_category").withColumn("off", F.abs(F.col("log_price") - F.col("median")))
    mads = exact_medians(off, "off", ["item_category"]).select("item_category", F.col("median").alias("mad"))
    return medians.join(mads, "item_category")


def scores(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """z of each row's residual after least squares of the relative log price on (1, log quantity, days), the price to expect, and the vendor's share of its category's spend. Three means, five sums, a date and two medians reach the driver.

    The eligible rows are written once, as five passes go over them.
    """
    keep = [c for c in ("row_id", "vendor_key", "item_category", "unit_price", "quantity", "amount", "txn_date") if c in tx.columns]
    every = written(eligible(tx.select(*keep)), "priced")
    stats = written(category_stats(every, t), "categories")
    rows = every.join(stats, "item_category").withColumns({"rel": F.col("log_price") - F.col("median"), "lq": F.log("quantity")})
    first = rows.agg(F.min("txn_date")).first()[0]
    rows = rows.withColumn("days", F.datediff("txn_date", F.lit(first)).cast("double"))
    x = ("lq", "days", "rel")
    means = rows.agg(*[F.avg(c).alias(c) for c in x]).first()
    if means["rel"] is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in ("vendor_share", "residual", "z", "expected_price", "score", "at_risk")})
    # About the means: sums of squares of days would else swamp those of the logarithms.
    off = {c: F.col(c) - float(means[c]) for c in x}
    money = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    spend = rows.groupBy("item_category").agg(money.alias("category_spend"))
    by_vendor = rows.groupBy("item_category", "vendor_key").agg(money.alias("vendor_spend")).join(spend, "item_category")
    rows = rows.join(by_vendor.select("item_category", "vendor_key", (F.col("vendor_spend") / F.col("category_spend")).alias("vendor_share")), ["item_category", "vendor_key"])
    sums = rows.agg(*[F.sum(off[a] * off[b]).alias(f"{a}_{b}") for a, b in (("lq", "lq"), ("lq", "days"), ("days", "days"), ("lq", "rel"), ("days", "rel"))]).first()
    gram = np.array([[sums["lq_lq"], sums["lq_days"]], [sums["lq_days"], sums["days_days"]]], float)
    beta = np.linalg.pinv(gram) @ np.array([sums["lq_rel"], sums["days_rel"]], float)
    rows = rows.withColumn("residual", off["rel"] - (float(beta[0]) * off["lq"] + float(beta[1]) * off["days"]))
    centre = exact_medians(rows, "residual", []).first()["median"]
    spread = exact_medians(rows.withColumn("off", F.abs(F.col("residual") - centre)), "off", []).first()["median"]
    z = (F.col("residual") - centre) / max(SCALE * spread, FLOOR)
    expected = F.exp(F.col("median") + float(beta[0]) * F.col("lq") + float(beta[1]) * F.col("days"))
    return rows.withColumns({"z": z, "expected_price": expected}).withColumns({"score": logistic(F.col("z") - t.price_z), "at_risk": F.greatest((F.col("unit_price") - F.col("expected_price")) * F.col("quantity"), F.lit(0.0))})


def detect(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Cases of the rows whose z is too high."""
    found = scores(tx, t).where(F.col("z") >= t.price_z).withColumns({"row_ids": F.array("row_id"), "score": F.round("score", 4)})
    more = {"policy_clause": F.lit(POLICY_CLAUSE), "item_category": F.col("item_category"), "category_size": F.col("n"), "unit_price": F.round("unit_price", 2), "category_median_price": F.round(F.exp("median"), 2), "expected_price": F.round("expected_price", 2), "times_expected": F.round(F.col("unit_price") / F.col("expected_price"), 2), "robust_z": F.round("z", 2), "quantity": F.col("quantity")}
    return cases.build(found, "d3", "inflation", t, more)
