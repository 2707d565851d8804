"""Vendor red flags: first digits, round numbers and period ends against peers, combined and controlled for false discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.stats import binomial_tail, chi2_tail_even, first_digit
from ..sources.scratch import written
from . import cases
from .ranks import running

POLICY_CLAUSES = ("SG-PP-5.5", "SG-PP-7.1")


def period_end(day: F.Column) -> F.Column:
    return (F.month(day) == 3) | (F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 4)


#: Rows without a category are a category of their own.
NO_CATEGORY = "(uncategorised)"


def tested(tx: DataFrame) -> DataFrame:
    """The rows that vendors are tested by."""
    return tx.where("amount > 0").withColumn("item_category", F.coalesce("item_category", F.lit(NO_CATEGORY)))


def distinct_amounts(tx: DataFrame) -> DataFrame:
    """One row a vendor and amount: of several the least row_id."""
    return tested(tx).groupBy("vendor_key", "amount").agg(F.min_by("item_category", "row_id").alias("item_category"))


def digit_shares(tx: DataFrame) -> DataFrame:
    """Share of each first digit among a category's distinct amounts."""
    counts = distinct_amounts(tx).groupBy("item_category", first_digit(F.col("amount")).alias("digit")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("item_category")))


def amount_cells(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A line for each vendor and category, stored: n, its distinct amounts, the least and the largest, k, how many are multiples of round_unit, and d1 to d9, how many begin with a digit. Both tests of amounts follow from it."""
    digit = first_digit(F.col("amount"))
    by = distinct_amounts(tx).groupBy("vendor_key", "item_category")
    return written(by.agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.count_if(F.col("amount") % t.round_unit == 0).alias("k"), *[F.count_if(digit == i).alias(f"d{i}") for i in range(1, 10)]), "cells")


def row_cells(tx: DataFrame) -> DataFrame:
    """A line for each vendor and category, stored: n, its rows, and k, how many are at a period's end."""
    return written(tested(tx).groupBy("vendor_key", "item_category").agg(F.count("*").alias("n"), F.count_if(period_end(F.col("txn_date"))).alias("k")), "cells")


def first_digit_test(tx: DataFrame, t: Thresholds = DEFAULT, cells: DataFrame | None = None) -> DataFrame:
    """Chi-square of each vendor's first digits against the mean shares of its rows' categories; 8 degrees. A digit that no peer has counts as a share of 1e-6."""
    cells = amount_cells(tx, t) if cells is None else cells
    digits = range(1, 10)
    many = (F.col("n") >= t.benford_min) & (F.col("n") >= t.min_distinct_amounts) & (F.col("range") >= 30)
    of = cells.groupBy("vendor_key").agg(F.sum("n").alias("n"), (F.max("most") / F.min("least")).alias("range")).where(many)
    peers = cells.groupBy("item_category").agg(*[(F.sum(f"d{i}") / F.sum("n")).alias(f"share{i}") for i in digits])
    both = cells.withColumnRenamed("n", "w").join(of.select("vendor_key", "n"), "vendor_key").join(peers, "item_category")
    by = both.groupBy("vendor_key").agg(F.max("n").alias("n"), *[(F.sum(F.col("w") * F.col(f"share{i}")) / F.max("n")).alias(f"peer{i}") for i in digits], *[F.sum(f"d{i}").alias(f"seen{i}") for i in digits])
    p = {i: F.when(F.col(f"peer{i}") > 0, F.col(f"peer{i}")).otherwise(1e-6) for i in digits}
    chi2 = sum((F.pow(F.col(f"seen{i}") - p[i] * F.col("n"), F.lit(2.0)) / (p[i] * F.col("n")) for i in digits), F.lit(0.0))
    apart = sum((F.abs(F.col(f"seen{i}") / F.col("n") - F.col(f"peer{i}")) for i in digits), F.lit(0.0))
    out = by.select("vendor_key", "n", chi2.alias("chi2"), (apart / 9).alias("mad"))
    return out.withColumn("p_value", chi2_tail_even(F.col("chi2"), 8)).where("mad >= 0.015")


def share_test(cells: DataFrame, t: Thresholds, lift: float) -> DataFrame:
    """One-sided binomial test of each vendor's share of hits against its rows' categories' mean rate; a category without any takes the rate of all. cells: vendor_key, item_category, n, k (hits). Only an excess of lift times the rate is material."""
    rates = cells.groupBy("item_category").agg((F.sum("k") / F.sum("n")).alias("rate"))
    overall = cells.agg((F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).alias("overall"))
    by = cells.join(rates, "item_category").crossJoin(F.broadcast(overall)).withColumn("rate", F.when(F.col("rate") == 0, F.col("overall")).otherwise(F.col("rate")))  # one row
    out = by.groupBy("vendor_key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), (F.sum(F.col("rate").cast("decimal(28,24)") * F.col("n").cast("decimal(12,0)")).cast("double") / F.sum("n")).alias("rate"))
    out = out.where((F.col("n") >= t.min_transactions) & (F.col("rate") > 0) & (F.col("rate") < 1))
    return out.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), F.col("rate"))).withColumn("material", F.col("k") / F.col("n") >= lift * F.col("rate"))


def round_number_test(tx: DataFrame, t: Thresholds = DEFAULT, lift: float = 2.0, cells: DataFrame | None = None) -> DataFrame:
    """Each vendor's share of distinct amounts that are multiples of round_unit, of vendors with enough of them."""
    return share_test(amount_cells(tx, t) if cells is None else cells, t, lift).where(F.col("n") >= t.min_distinct_amounts)


def period_end_test(tx: DataFrame, t: Thresholds = DEFAULT, lift: float = 2.0) -> DataFrame:
    """Each vendor's share of rows at a period's end."""
    return share_test(row_cells(tx), t, lift)


def fisher(tests: DataFrame) -> DataFrame:
    """One p a vendor from one to three tests: chi-square with twice as many degrees."""
    x = tests.groupBy("vendor_key").agg(F.count("*").alias("k"), (-2 * F.sum(F.log(F.greatest("p_value", F.lit(1e-300))))).alias("x"))
    p = F.when(F.col("k") == 1, chi2_tail_even(F.col("x"), 2)).when(F.col("k") == 2, chi2_tail_even(F.col("x"), 4)).otherwise(chi2_tail_even(F.col("x"), 6))
    return x.select("vendor_key", p.alias("combined_p"))


def benjamini_hochberg(p: DataFrame, alpha: float = DEFAULT.fdr_alpha) -> DataFrame:
    """flagged where p is at most the largest p with p <= alpha * rank / n. Vendors are ranked over ranges of p."""
    ranked = running(p, ["combined_p", "vendor_key"], rank="rank")
    n = ranked.count()
    cutoff = ranked.where(F.col("combined_p") <= alpha * F.col("rank") / F.lit(n)).agg(F.max("combined_p")).first()[0] or 0.0
    return ranked.drop("rank").withColumn("cutoff", F.lit(cutoff).cast("double")).withColumn("flagged", F.col("combined_p") <= F.col("cutoff"))


def evidence(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """vendor_key, test, p_value of every test that speaks against a vendor, stored. tx is read twice: for its distinct amounts and for its rows."""
    cells = amount_cells(tx, t)
    tests = first_digit_test(tx, t, cells).select("vendor_key", F.lit("first_digit").alias("test"), "p_value")
    for name, shares in (("round_numbers", round_number_test(tx, t, cells=cells)), ("period_end", period_end_test(tx, t))):
        tests = tests.unionByName(shares.where("material").select("vendor_key", F.lit(name).alias("test"), "p_value"))
    return written(tests, "evidence")


def score(combined_p: F.Column) -> F.Column:
    return F.least(F.lit(1.0), -F.log10(F.greatest(combined_p, F.lit(1e-300))) / 20)


def flagged(tests: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return benjamini_hochberg(fisher(tests), t.fdr_alpha).withColumn("score", score(F.col("combined_p")))


def flags(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return flagged(evidence(slim(tx), t), t)


def slim(tx: DataFrame) -> DataFrame:
    """The columns that vendors are tested by, of the rows that count, stored: a view of several tables is joined once."""
    return written(tested(tx).select("row_id", "vendor_key", "vendor_name", "item_category", "amount", "txn_date", "officer_id"), "tested")


def roll_up(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """What is known of each vendor: rows, total, largest amount, first date, name, officers, and whether it is new and yet takes amounts that need approval."""
    rows = tested(tx)
    start = rows.agg(F.min("txn_date").alias("start"))
    out = rows.groupBy("vendor_key").agg(
        F.count("*").alias("n"), F.count_distinct("amount").alias("n_amounts"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.max("amount").alias("largest"), F.min("txn_date").alias("first_seen"),
        F.min_by("vendor_name", "row_id").alias("vendor_name"), F.array_sort(F.collect_set("officer_id")).alias("officers"),
    )
    new = (F.datediff("first_seen", "start") > t.new_vendor_days) & (F.col("largest") >= t.approval)
    return out.crossJoin(F.broadcast(start)).withColumn("new_vendor_high_value", new).drop("start")  # one row


def detect(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Cases of the flagged vendors, each of all the vendor's rows."""
    rows = slim(tx)
    tests = evidence(rows, t)
    found = flagged(tests, t).where("flagged")
    names = tests.groupBy("vendor_key").agg(F.array_join(F.array_sort(F.collect_set("test")), ",").alias("indicators"))  # three at most
    ids = rows.join(found.select("vendor_key"), "vendor_key", "left_semi").groupBy("vendor_key").agg(F.collect_list("row_id").alias("row_ids"))
    found = found.join(roll_up(rows, t), "vendor_key").join(ids, "vendor_key").join(names, "vendor_key").withColumns({"score": F.round("score", 4), "at_risk": F.col("total")})
    more = {"policy_clauses": F.lit(",".join(POLICY_CLAUSES)), "vendor_name": F.col("vendor_name"), "transactions": F.col("n"), "distinct_amounts": F.col("n_amounts"), "indicators": F.col("indicators"), "first_seen": F.col("first_seen").cast("string"), "officers": F.array_join("officers", ","), "new_vendor_high_value": F.col("new_vendor_high_value")}
    return cases.build(found, "d4", "vendor_flag", t, more)
