import datetime as dt
import random

import pytest

from ledgerlens.config import Thresholds
from ledgerlens.operators import runs
from ledgerlens.streaming.split_runs import DAY_MS, fold, split_runs

DAY = dt.date(2024, 1, 1)
SMALL = Thresholds(approval=10.0)
FIELDS = "vendor_key string, officer_id string, txn_date date, row_id long, amount double"
#: A row so late in time that all others are final.
LAST = [("zz", None, dt.date(2060, 1, 1), 10**6, 0.01)]


def ledger(seed, n=40):
    r, rows = random.Random(seed), []
    for v, o in (("a", "x"), ("a", None), ("b", "x")):
        day = DAY
        for _ in range(n):
            day += dt.timedelta(r.randrange(3))
            rows.append((v, o, day, r.randrange(10**9), r.choice([0.5, 1.5, 3.0, 5.0, 9.99])))
    return rows


def key(r):
    return (r.vendor_key, r.officer_id, tuple(r.row_ids), r.total, r.first_date, r.last_date, r.n_parts)


def batch(spark, rows):
    return sorted(map(key, runs.minimal_runs(spark.createDataFrame(rows, FIELDS), SMALL).collect()), key=str)


def feed(spark, folder, batches, at, lateness):
    """Runs of a stream that gets the batches one by one, each in a query that is stopped and started again from the checkpoint."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(FIELDS).parquet(f"{folder}/in")
        out = split_runs(stream, SMALL, lateness).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        out.trigger(availableNow=True).start().awaitTermination()
    return sorted(map(key, spark.read.parquet(f"{folder}/out").collect()), key=str)


@pytest.fixture(scope="module", autouse=True)
def few_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_gives_the_batch_runs(spark, tmp_path):
    """Rows in three batches in any order, restarted between each, with a lateness that covers them."""
    rows = ledger(1)
    want = batch(spark, rows)
    mixed = random.Random(2).sample(rows, len(rows))
    got = feed(spark, tmp_path, [mixed[:50], mixed[50:], LAST], DAY, "3650 days")
    assert len(want) > 15 and got == want


def test_stream_in_order_of_days(spark, tmp_path):
    """Batches by day with a week's lateness: runs that cross batches come from the window's state, and some come before the end."""
    rows = sorted(ledger(3), key=lambda r: r[2])
    want = batch(spark, rows)
    assert feed(spark, tmp_path, [rows[:60], rows[60:], LAST], DAY, "7 days") == want


def test_late_rows(spark, tmp_path):
    """A row within the lateness takes its place; one whose day the watermark has passed is left out."""
    d = lambda n: DAY + dt.timedelta(n)
    first = [("a", None, d(20), 1, 6.0), ("a", None, d(2), 2, 6.0)]
    in_time, too_late = ("a", None, d(18), 3, 4.0), ("a", None, d(3), 4, 6.0)
    got = feed(spark, tmp_path, [first, [("b", None, d(21), 9, 1.0)], [in_time, too_late], LAST], DAY, "5 days")
    assert [g[2] for g in got] == [(3, 1)] and got == batch(spark, [*first, in_time])


def test_fold_in_any_pieces():
    """Folding piece by piece is folding at once."""
    r = random.Random(5)
    for _ in range(200):
        day, rows = 0, []
        for i in range(r.randrange(1, 25)):
            day += r.randrange(6)
            rows.append((day * DAY_MS, i, r.randrange(1, 6)))
        whole, _ = fold([], rows, 9, 14)
        cut, window, found = r.randrange(len(rows) + 1), [], []
        for piece in (rows[:cut], rows[cut:]):
            more, window = fold(window, piece, 9, 14)
            found += more
        assert found == whole
