import datetime as dt
import itertools
import random

import numpy as np
import pytest

from ledgerlens.config import DEFAULT
from ledgerlens.functions.names import similarity_of
from ledgerlens.operators import bands, forest, linkage, vendors
from ledgerlens.plans import intake


def test_long_invoice_numbers(spark, tmp_path):
    """numbers of over six digits are not cut."""
    keys = [0, 41, 999_995, 1_234_567, 98_765_432]
    spark.createDataFrame([(k, dt.datetime(1996, 2, 1), "5-LOW") for k in keys], "o_orderkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.bumped, r.written) for r in intake.stated(spark, str(tmp_path)).collect()}
    assert got == {k: (f"INV-{k + 7:06d}/A", f"{k} {k}/1996 INV/{f'{k:06d}'[:6]} {k}/96") for k in keys}


def test_small_rates_are_whole(spark):
    """a rate of few in a hundred million keeps all its digits."""
    cells = spark.createDataFrame([("a", "x", 1000, 3), ("b", "x", 100_000_003, 4)], "vendor_key string, item_category string, n long, k long")
    got = vendors.share_test(cells, DEFAULT, 2.0).collect()
    assert len(got) == 2 and all(r.rate == pytest.approx(7 / 100_001_003, rel=1e-12, abs=0) for r in got)


def test_band_shuffles_cells_not_copies(spark, tmp_path, monkeypatch):
    """rows are dealt once, by cell, with few copies, in either window, and the pairs are those of a nested loop."""
    r = random.Random(5)
    rows = [(i, r.choice([100.0, 100.3, 101.0, 250.0]) + r.random(), dt.date(2025, 4, 1) + dt.timedelta(r.randrange(-300, 300))) for i in range(250)]
    spark.createDataFrame(rows, "row_id long, amount double, txn_date date").write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(bands, "TASK_BYTES", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for low, high in ((0, 14), (30, 180)):
            pairs = bands.amount_pairs(spark.read.parquet(f"{tmp_path}/rows"), days=(low, high))
            got = sorted((x.a_row_id, x.b_row_id) for x in pairs.collect())
            want = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if abs(a[1] - b[1]) < 0.005 * max(a[1], b[1]) and low <= abs((a[2] - b[2]).days) <= high]
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            assert got == want and want and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_band_within_one_vendor(spark):
    """the band of rows that agree in a column, a null agreeing with none."""
    r = random.Random(6)
    rows = [(i, r.choice([100.0, 100.3, 250.0]), dt.date(2025, 4, 1) + dt.timedelta(r.randrange(60)), r.choice(["x", "y", None])) for i in range(120)]
    got = {(x.a_row_id, x.b_row_id) for x in bands.amount_pairs(spark.createDataFrame(rows, "row_id long, amount double, txn_date date, vendor_key string"), same=("vendor_key",)).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[3] and a[3] == b[3] and abs(a[1] - b[1]) < 0.005 * max(a[1], b[1]) and abs((a[2] - b[2]).days) <= 14}
    assert got == want and want


def test_forest_draws_a_large_table_once(spark, monkeypatch):
    """rows of a large table are drawn once, not for every tree, and scored in one pass; scores are those of a plain walk."""
    r = np.random.default_rng(1)
    x = r.random((400, 4))
    x[7] = 50.0
    kept, ids = [], []
    monkeypatch.setattr(forest, "written", lambda df, name, f=forest.written: (kept.append(name), f(df, name))[1])
    monkeypatch.setattr(forest, "draw", lambda seed, purpose, *by, f=forest.draw: (ids.append(str(by[-1])), f(seed, purpose, *by))[1])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, rel double, lq double, vendor_share double, days double")
    got = forest.second_opinion(rows, trees=5, held=8).toPandas()
    assert len(got) == 400 and kept == ["features", "forest"] and not any("tree" in i for i in ids)
    grown = forest.Forest([x[:100], x[100:130]], 3)

    def depth(tree, v):
        feature, cut, child, deep = tree
        at = 0
        while child[at] >= 0:
            at = child[at] + (v[feature[at]] > cut[at])
        return deep[at]

    want = [-(2.0 ** (-sum(depth(t, v) for t in grown.trees) / 2 / grown.scale)) for v in x]
    assert np.allclose(grown.scores(x), want, rtol=1e-12)


def test_pairs_carry_numbers_for_names(spark, monkeypatch):
    """Pairs have no texts of names, a pair of names is compared once whichever comes first, and invoice numbers of one or several groups are compared alike."""
    names = ["Sharma Traders", "Sharma Trader", "Gupta", None]
    invoices = ["A-7", "B-7/8", "8-7", "9", "10-11", None]
    rows = [(i, names[i % 4], invoices[i % 6], 100.0, dt.date(2025, 4, 1) + dt.timedelta(i % 40), "x", "p", 1.0) for i in range(48)]
    told = linkage.comparable(spark.createDataFrame(rows, "row_id long, vendor_name string, invoice_no string, amount double, txn_date date, officer_id string, item_category string, quantity double"))
    pairs = linkage.levels(bands.band(told))
    groups = {"A-7": {7}, "B-7/8": {7, 8}, "8-7": {7, 8}, "9": {9}, "10-11": {10, 11}}
    for x in pairs.select("p_row_id", "q_row_id", "invoice").collect():
        a, b = rows[x.p_row_id][2], rows[x.q_row_id][2]
        assert x.invoice == (3 if a is None or b is None else 0 if a == b else 1 if groups[a] & groups[b] else 2)
    met = []
    monkeypatch.setattr(linkage, "similar_names", lambda df, t, f=linkage.similar_names: (met.append([frozenset(r) for r in df.select("p_vendor_name", "q_vendor_name").collect()]), f(df, t))[1])
    got = {(r.a_row_id, r.b_row_id): r.sim for r in linkage.candidates(told).collect()}
    assert len(met[0]) == len(set(met[0])) and not {"p_vendor_name", "q_vendor_name"} & set(linkage.ALIKE)
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a[1] and b[1] and abs((a[4] - b[4]).days) <= 14 and similarity_of(a[1], b[1]) >= 80:
            want[a[0], b[0]] = similarity_of(a[1], b[1])
    assert got == want and len(want) > 20
