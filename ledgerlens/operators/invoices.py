"""Invoice numbers as suppliers give them: one after another by date, over all years or within each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fiscal_year
from .ranks import running


def numbered(tx: DataFrame) -> DataFrame:
    """row_id, vendor_key, txn_date, seq, year_seq, plain, by_year: each row's place among its vendor's rows by date and row_id, its place within the financial year, and both as numbers on an invoice.

    A place is the row's rank in the whole table less that of the first row of its vendor, or vendor and year. As rows are ordered by vendor and date, the greatest (vendor, year, -rank) up to a row is that first row, so a vendor with many rows is spread over ranges like any others.
    """
    order = ["vendor_key", "txn_date", "row_id"]
    rows = running(tx.select("row_id", "vendor_key", "txn_date"), order, rank="g")
    year = F.year("txn_date") - F.when(F.month("txn_date") < 4, 1).otherwise(0)
    below = (-F.col("g")).alias("below")
    rows = running(rows, order, maxima={"_vendor": F.struct("vendor_key", below), "_year": F.struct("vendor_key", year.alias("year"), below)})
    rows = rows.withColumns({"seq": F.col("g") + F.col("_vendor.below") + 1, "year_seq": F.col("g") + F.col("_year.below") + 1})
    plain, by_year = F.format_string("INV-%05d", "seq"), F.concat_ws("/", fiscal_year(F.col("txn_date")), F.format_string("%03d", "year_seq"))
    return rows.select("row_id", "vendor_key", "txn_date", "seq", "year_seq", plain.alias("plain"), by_year.alias("by_year"))
