import datetime as dt
import itertools
import random

import pytest

from ledgerlens.functions.names import identity_of, key_of, similarity_of
from ledgerlens.operators import bands, baseline, evaluate, explore, linkage, runs, vendors

DAY = dt.date(2025, 4, 1)
FIELDS = "row_id long, vendor_name string, vendor_key string, invoice_no string, amount double, txn_date date, officer_id string, item_desc string, item_category string, quantity double, unit_price double"


def tx(spark, rows):
    base = {"vendor_name": "Sharma Traders", "vendor_key": "sharma", "invoice_no": None, "amount": 5000.0, "txn_date": DAY, "officer_id": "ADM-001", "item_desc": "Paper", "item_category": "Paper", "quantity": 10.0, "unit_price": 500.0}
    full = [base | {"row_id": i, "invoice_no": f"INV-{i:05d}"} | r for i, r in enumerate(rows, 1)]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FIELDS)


@pytest.mark.parametrize("name", ["Sharma Enterprises", "SHARMA ENTERPRISES PVT LTD", "Sharma  Enterprise", "Enterprises Sharma", "M/s. Sharma Enterprises Private Limited", "Messrs Sharma Enterprises", "The Sharma Enterprises", "Sharma Tradres", "Sharma Enterprsies"])
def test_vendor_keys(name):
    assert key_of(name) == "sharma"


def test_other_names():
    assert key_of("Saxena Petroleum Pvt Ltd") == "petroleum saxena"
    assert key_of(None) == key_of("  ") == "" and key_of("Traders & Co")
    assert identity_of("Sharma Traders Pvt. Ltd.") == "sharma traders"
    assert similarity_of("Saxena Petroleum", "Petroleum Saxena") >= 90 and similarity_of("Sharma Traders", "Sharma Electricals") < 75


@pytest.mark.parametrize(("amount", "near"), [(10_000, True), (10_049, True), (10_050, True), (10_051, False), (9_950, False), (9_951, True), (9_900, False)])
def test_tolerance(spark, amount, near):
    rows = tx(spark, [{"amount": 10_000.0}, {"amount": float(amount)}])
    assert (bands.amount_pairs(rows).count() == 1) is near


def test_band_join_is_a_nested_loop(spark):
    r = random.Random(1)
    rows = [{"amount": r.choice([100.0, 100.3, 101.0, 250.0]) + r.random(), "txn_date": DAY + dt.timedelta(r.randrange(60))} for _ in range(60)]
    got = {(x.a_row_id, x.b_row_id) for x in bands.amount_pairs(tx(spark, rows)).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(rows, 1), 2) if abs(a["amount"] - b["amount"]) < 0.005 * max(a["amount"], b["amount"]) and abs((a["txn_date"] - b["txn_date"]).days) <= 14}
    assert got == want


@pytest.mark.parametrize(("parts", "want"), [([(0.4, 0), (0.4, 2), (0.4, 4)], [[1, 2, 3]]), ([(0.3, 0), (0.3, 1)], []), ([(0.5, 0), (0.5, 1)], [[1, 2]]), ([(0.6, 0), (0.6, 15)], []), ([(0.05, 0), (0.5, 1), (0.6, 2)], [[2, 3]])])
def test_runs(spark, parts, want):
    rows = tx(spark, [{"amount": 250_000 * p, "txn_date": DAY + dt.timedelta(d), "officer_id": None} for p, d in parts])
    assert [x.row_ids for x in runs.minimal_runs(rows).collect()] == want


def test_em():
    strong, weak = (0, 0, 0, 0), (2, 2, 3, 2)
    post, _, _ = linkage.fit({strong: 200, weak: 2000})
    assert post[strong] > 0.9 and post[weak] < 0.05


def test_linkage_crosses_vendor_keys(spark, monkeypatch):
    """Similar names of different keys are linked, and u is taken from the look-alikes 30 to 180 days apart."""
    a, b = {"vendor_name": "Saxena Petroleum", "vendor_key": "petroleum saxena"}, {"vendor_name": "Saxena Petrolium", "vendor_key": "petrolium saxena"}
    other = {"vendor_name": "Gupta Stationers", "vendor_key": "gupta stationers"}
    rows = tx(spark, [a, b | {"txn_date": DAY + dt.timedelta(2)}, other, *[b | {"txn_date": DAY + dt.timedelta(40 + 20 * i)} for i in range(3)]])
    seen, fit = [], linkage.fit
    monkeypatch.setattr(linkage, "fit", lambda counts, reference=None, t=linkage.DEFAULT: seen.append((sum(counts.values()), reference)) or fit(counts, reference, t))
    assert [(r.a_row_id, r.b_row_id) for r in linkage.linked(rows).collect()] == [(1, 2)]
    (n, reference), = seen
    near = [(i, j) for i, j in itertools.combinations([0, 2, 40, 60, 80], 2) if 30 <= j - i <= 180]
    assert n == 1 and sum(reference.values()) == len(near)


def test_baseline_rules(spark):
    rows = tx(spark, [{"invoice_no": "INV-1"}, {"invoice_no": "INV-1", "vendor_name": " sharma traders"}, {"amount": 0.89 * 250_000}, {"amount": 0.9 * 250_000}, {"amount": 250_000.0}])
    assert [x.row_ids for x in baseline.duplicates(rows).collect()] == [[1, 2]]
    assert [x.row_id for x in baseline.near_threshold(rows).collect()] == [4]


def test_round_numbers_alone_flag_a_vendor(spark):
    day = DAY + dt.timedelta(9)
    rows = [{"vendor_key": "round", "amount": 1000.0 * (10 + i), "txn_date": day} for i in range(25)]
    rows += [{"vendor_key": f"v{v}", "amount": 10_000.0 + 37 * i + v, "txn_date": day} for v in range(1, 9) for i in range(25)]
    rows += [{"vendor_key": "few", "amount": 1000.0 * (10 + i), "txn_date": day} for i in range(19)]
    rows += [{"vendor_key": "copies", "amount": 1000.0, "txn_date": day, "item_category": None}] * 30
    table = tx(spark, rows)
    got = {r.vendor_key: r for r in vendors.round_number_test(table).collect()}
    assert set(got) == {"round", *(f"v{v}" for v in range(1, 9))}
    rate = (25 + 19 + sum(x["amount"] % 1000 == 0 for x in rows[25:225])) / (25 + 200 + 19)
    assert got["round"].n == got["round"].k == 25 and got["round"].rate == pytest.approx(rate, abs=1e-9) and got["round"].p_value == pytest.approx(rate**25, rel=1e-6)
    assert {r.vendor_key for r in vendors.flags(table).collect() if r.flagged} == {"round"}


def test_krippendorff(spark):
    n = None
    coders = [[n, n, n, n, n, 3, 4, 1, 2, 1, 1, 3, 3, n, 3], [1, n, 2, 1, 3, 3, 4, 3, n, n, n, n, n, n, n], [n, n, 2, 1, 3, 4, 4, n, 2, 1, 1, 3, 3, n, 4]]
    rows = spark.createDataFrame([(u, c, v) for c, x in enumerate(coders) for u, v in enumerate(x)], "unit int, coder int, value int")
    assert round(evaluate.krippendorff(rows), 3) == 0.691 and round(evaluate.krippendorff(rows, ordinal=True), 3) == 0.807


def test_average_precision_and_matches(spark):
    assert evaluate.average_precision(spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True)], "score double, hit boolean"), 2).first().ap == pytest.approx((1 + 2 / 3) / 2)
    c = spark.createDataFrame([("a", 0.5, [1, 2]), ("b", 0.9, [2, 3]), ("c", 0.4, [9, 10, 11, 1])], "case_id string, score double, row_ids array<long>")
    t = spark.createDataFrame([("g", [1, 2, 3])], "group_id string, rows array<long>")
    assert [tuple(r) for r in evaluate.greedy(evaluate.candidate_matches(c, t)).collect()] == [("b", "g")]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM audit_transactions, transactions", 'SELECT * FROM `transactions`', "SELECT * FROM audit_transactions JOIN ground_truth USING (row_id)"])
def test_guard(spark, sql):
    tx(spark, [{}]).createOrReplaceTempView("audit_transactions")
    with pytest.raises(ValueError):
        explore.guarded(spark, sql)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
