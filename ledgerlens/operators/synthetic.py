"""An invented ledger: vendors with house styles, categories with price levels, a calendar with seasons."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, pick
from ..functions.text import fiscal_year

# How much is bought on a Saturday, on a Sunday, in March and at a month's end, beside a plain day.
SATURDAY, SUNDAY, MARCH, MONTH_END = 0.25, 0.05, 1.8, 1.3
SURNAMES = ("Agarwal", "Bose", "Chopra", "Desai", "Gupta", "Iyer", "Joshi", "Khan", "Mehta", "Nair", "Patel", "Rao", "Saxena", "Sharma", "Verma")
TRADES = ("Traders", "Enterprises", "Stationers", "Electricals", "Petroleum", "Hardware", "Services", "Motors")
GOODS = (("Stationery", "Paper ream", 280.0), ("Electrical", "LED tube", 450.0), ("Fuel", "Diesel litre", 90.0), ("Furniture", "Office chair", 6500.0), ("IT", "Laptop", 62_000.0), ("Cleaning", "Floor cleaner", 210.0), ("Consulting", "Advisory day", 25_000.0))


def weight(day: dt.date) -> float:
    """How much is bought on a day beside a plain one."""
    w = {5: SATURDAY, 6: SUNDAY}.get(day.weekday(), 1.0)
    last = (day.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)
    return w * (MARCH if day.month == 3 else 1.0) * (MONTH_END if day.day > last.day - 3 else 1.0)


def sampled_day(u: Column, start: dt.date, end: dt.date) -> Column:
    """A day of the calendar by a draw, as likely as its weight. The days' running sums are one array; a day is how many of them the draw exceeds."""
    days = [start + dt.timedelta(i) for i in range((end - start).days + 1)]
    upto = np.cumsum([weight(d) for d in days])
    sums = F.array(*[F.lit(float(x)) for x in upto / upto[-1]])
    at = F.least(F.size(F.filter(sums, lambda x: x <= u)), F.lit(len(days) - 1))
    return F.date_add(F.lit(start), at.cast("int"))


def vendors(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """vendor, vendor_name, prefix, style: names are distinct by their number."""
    v = spark.range(n).select(F.col("id").alias("vendor"))
    u = lambda p: draw(seed, f"ledger-{p}", F.col("vendor"))
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    name = F.concat_ws(" ", pick(u("surname"), words(*SURNAMES)), F.format_string("No%d", "vendor"), pick(u("trade"), words(*TRADES)), pick(u("form"), words("Pvt Ltd", "Private Limited", "& Co", "LLP")))
    return v.select("vendor", name.alias("vendor_name"), F.concat(F.upper(F.substring(name, 1, 2)), F.col("vendor").cast("string")).alias("prefix"), F.floor(u("style") * 5).cast("int").alias("style"))


def ledger(spark: SparkSession, n: int, n_vendors: int = 200, officers: int = 25, seed: int = 42, start: dt.date = dt.date(2023, 4, 1), end: dt.date = dt.date(2025, 3, 31)) -> DataFrame:
    """n rows of a purchase ledger in canonical columns, by vendor style, goods and calendar. Rows follow from their number and the seed alone, so any number of tasks makes the same ledger; an invoice's number is its row's place among its vendor's by date."""
    rows = spark.range(1, n + 1).select(F.col("id").alias("row_id"))
    rows = rows.withColumns({f"_{p}": draw(seed, f"ledger-{p}", F.col("row_id")) for p in ("vendor", "day", "goods", "quantity", "price", "officer")})
    # Few vendors have much: a squared draw.
    rows = rows.withColumns({"vendor": F.floor(F.col("_vendor") * F.col("_vendor") * n_vendors), "txn_date": sampled_day(F.col("_day"), start, end)})
    rows = rows.withColumn("_g", pick(F.col("_goods"), F.array(*[F.struct(F.lit(c).alias("category"), F.lit(d).alias("item"), F.lit(p).alias("price")) for c, d, p in GOODS])))
    quantity = F.when(F.col("_g.category") == "Consulting", 1.0).otherwise(F.greatest(F.lit(1.0), F.round(F.exp(F.col("_quantity") * 4))))
    price = F.round(F.col("_g.price") * (0.85 + 0.3 * F.col("_price")) * (1 - 0.02 * F.log(quantity)), 2)
    rows = rows.withColumns({"quantity": quantity, "unit_price": price}).withColumn("amount", F.round(F.col("quantity") * F.col("unit_price"), 2))
    rows = rows.join(vendors(spark, n_vendors, seed), "vendor")
    fy = fiscal_year(F.col("txn_date"))
    by = Window.partitionBy("vendor").orderBy("txn_date", "row_id")
    rows = rows.withColumns({"_seq": F.row_number().over(by), "_fy": F.row_number().over(Window.partitionBy("vendor", fy).orderBy("txn_date", "row_id"))})
    styles = (
        F.format_string("INV-%05d", "_seq"), F.concat_ws("/", "prefix", fy, F.format_string("%03d", "_fy")), F.col("_seq").cast("string"),
        F.concat(F.col("prefix"), F.lit("-"), F.date_format("txn_date", "yy"), F.format_string("%04d", "_seq")), F.format_string("BILL/%04d", "_seq"),
    )
    invoice = F.element_at(F.array(*styles), F.col("style") + 1)
    key = F.concat_ws("-", F.lit("v"), F.col("vendor").cast("string"))
    return rows.select("row_id", "vendor_name", key.alias("vendor_key"), invoice.alias("invoice_no"), "amount", "txn_date", F.format_string("ADM-%03d", (F.floor(F.col("_officer") * officers) + 1).cast("int")).alias("officer_id"), F.col("_g.item").alias("item_desc"), F.col("_g.category").alias("item_category"), "quantity", "unit_price")
