"""The canonical audit view over the provided order and line-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_FIELDS = ("row_id", "vendor_name", "vendor_key", "invoice_no", "amount", "txn_date", "officer_id", "item_desc", "item_category", "quantity", "unit_price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_id(*parts: Column) -> Column:
    """A 60-bit number from the parts' text: a row id that needs no global order."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def ascii_key(name: Column) -> Column:
    """Sorted lower-case words of a plain-ASCII name."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


#: Bytes of a table's files up to which it may be sent whole to every executor; it is many times as large in memory.
BROADCAST_FILES = 10 << 20


def small(df: DataFrame) -> DataFrame:
    """A stored table, not to be broadcast unless all its files are small. Spark goes by the columns that are read: of seven million parts with two short columns it takes a few MB, and holds them in the driver as hundreds."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size <= BROADCAST_FILES else df.hint("merge")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row a line item: supplier as vendor, order priority as officer, part type as category."""
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    key = content_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate").cast("date"), cents("l_extendedprice"), cents("l_quantity"), cents("l_discount"), cents("l_tax"))
    # The id stands for six columns before anything is shuffled, and names are joined last.
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", key.alias("row_id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("date").alias("txn_date"), F.col("l_quantity").alias("quantity"))
    orders = small(table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderpriority")
    supplier = small(table(spark, sf_dir, "supplier")).select("s_suppkey", F.col("s_name").alias("vendor_name"), ascii_key(F.col("s_name")).alias("vendor_key"))
    part = small(table(spark, sf_dir, "part")).select("p_partkey", "p_name", "p_type")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        "row_id", "vendor_name", "vendor_key", F.concat(F.lit("INV-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("invoice_no"), "amount", "txn_date",
        F.col("o_orderpriority").alias("officer_id"), F.col("p_name").alias("item_desc"), F.col("p_type").alias("item_category"), "quantity", (F.col("amount") / F.col("quantity")).alias("unit_price"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row an order: customer as vendor, no invoice, segment as category."""
    customer = small(table(spark, sf_dir, "customer")).select("c_custkey", "c_name", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None)
    return rows.select(
        F.col("o_orderkey").alias("row_id"), F.col("c_name").alias("vendor_name"), ascii_key(F.col("c_name")).alias("vendor_key"), none.cast("string").alias("invoice_no"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("date").alias("txn_date"), F.col("o_orderpriority").alias("officer_id"), none.cast("string").alias("item_desc"), F.col("c_mktsegment").alias("item_category"), none.cast("double").alias("quantity"), none.cast("double").alias("unit_price"),
    )


#: The same two views in DuckDB's SQL.
TX_SQL = """tx AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE), CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_quantity AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)))), 1, 15))::BIGINT AS row_id,
  s_name AS vendor_name, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ') AS vendor_key,
  'INV-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS invoice_no, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS txn_date, o_orderpriority AS officer_id, p_name AS item_desc, p_type AS item_category, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
TXO_SQL = """txo AS (SELECT o_orderkey AS row_id, c_name AS vendor_name, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ') AS vendor_key,
  CAST(NULL AS VARCHAR) AS invoice_no, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS txn_date, o_orderpriority AS officer_id, CAST(NULL AS VARCHAR) AS item_desc, c_mktsegment AS item_category, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS unit_price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
