import datetime as dt
import random

from ledgerlens.operators import invoices, ranks


def test_numbers_of_each_vendor_and_year(spark, monkeypatch):
    """By the plain rule, with ranges that cut vendors and years anywhere, ties of dates, and a null vendor."""
    monkeypatch.setattr(ranks, "ranged", lambda df, order, parts=None, f=ranks.ranged: f(df, order, 11))
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), dt.date(2023, 1, 1) + dt.timedelta(r.randrange(900))) for i in r.sample(range(1000), 200)]
    seq, by_year, want = {}, {}, {}
    for i, v, d in sorted(rows, key=lambda x: (x[1] or "", x[2], x[0])):
        fy = d.year - (d.month < 4)
        seq[v], by_year[v, fy] = seq.get(v, 0) + 1, by_year.get((v, fy), 0) + 1
        want[i] = (seq[v], by_year[v, fy], f"INV-{seq[v]:05d}", f"{fy % 100:02d}-{(fy + 1) % 100:02d}/{by_year[v, fy]:03d}")
    got = invoices.numbered(spark.createDataFrame(rows, "row_id long, vendor_key string, txn_date date").repartition(3)).collect()
    assert {g.row_id: (g.seq, g.year_seq, g.plain, g.by_year) for g in got} == want
