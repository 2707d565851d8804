import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import tables

DAY = dt.date(2024, 1, 1)


def scanned(df):
    """Rows that the scan gave on, which are those of the row groups that it did not leave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    metric = plan.collectLeaves().apply(0).metrics().apply("numOutputRows")
    return metric.value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(r.randrange(10**12) * 2, "hot" if i % 3 == 0 else f"v{i % 40}", DAY + dt.timedelta(r.randrange(400)), 1.0) for i in range(6000)]
    path = f"{tmp_path_factory.mktemp('indexed')}/t"
    tables.write_indexed(spark.createDataFrame(rows, "row_id long, vendor_key string, txn_date date, amount double"), path, group_rows=200, parts=8)
    return path, rows


def test_lookups_read_few_row_groups(spark, stored):
    """By id (Bloom filters, also of ids that are nowhere), by vendor and by a vendor's days (least and largest values)."""
    path, rows = stored
    assert scanned(spark.read.parquet(path)) == 6000
    one = rows[77][0]
    by_id = tables.lookup(spark, path, row_ids=[one])
    assert [x.row_id for x in by_id.collect()] == [one] and scanned(tables.lookup(spark, path, row_ids=[one])) <= 1200
    assert scanned(tables.lookup(spark, path, row_ids=[one + 1])) <= 1000
    by_vendor = tables.lookup(spark, path, vendors=["v7"])
    assert by_vendor.count() == sum(x[1] == "v7" for x in rows) and scanned(tables.lookup(spark, path, vendors=["v7"])) <= 1500
    days = (DAY + dt.timedelta(100), DAY + dt.timedelta(103))
    both = tables.lookup(spark, path, vendors=["hot"], days=days)
    assert both.count() == sum(x[1] == "hot" and days[0] <= x[2] <= days[1] for x in rows) and scanned(tables.lookup(spark, path, vendors=["hot"], days=days)) <= 1500


def test_a_vendor_of_many_rows_is_in_several_files(spark, stored):
    path, _ = stored
    assert spark.read.parquet(path).where("vendor_key = 'hot'").select(F.input_file_name()).distinct().count() > 1


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    types = dict(tables.CANONICAL)
    row = spark.range(3).select(*[(F.col("id") if c == "row_id" else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    tables.replace_table(row, path)
    with pytest.raises(Exception):  # noqa: B017
        tables.replace_table(row.withColumn("row_id", F.raise_error(F.lit("broken")).cast("long")), path)
    assert spark.read.parquet(path).count() == 3
    tables.replace_table(row.limit(1), path)
    assert spark.read.parquet(path).count() == 1 and not [x for x in tmp_path.iterdir() if ".old-" in x.name]
