import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Thresholds
from ledgerlens.operators import evaluate, ranks, runs, vendors

DAY = dt.date(2024, 1, 1)
SMALL = Thresholds(approval=10.0)


def greedy(rows, limit, days):
    """Runs by the plain rule: the first to end, cut from the front while what remains reaches the limit. rows: vendor, officer, day, row_id, cents."""
    out = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3])), key=lambda r: r[:2]):
        g, i = [*group], 0
        while i < len(g):
            total = end = 0
            for j in range(i, len(g)):
                if (g[j][2] - g[i][2]).days > days:
                    break
                total += g[j][4]
                if total >= limit:
                    end = j + 1
                    break
            if not end:
                i += 1
                continue
            while total - g[i][4] >= limit:
                total -= g[i][4]
                i += 1
            out.append((g[i][0], g[i][1], tuple(x[3] for x in g[i:end]), total))
            i = end
    return sorted(out, key=str)


def ledger(seed, n, vendors=("a", "b"), step=3):
    r, rows = random.Random(seed), []
    for v in vendors:
        for o in ("x", None):
            day = DAY
            for _ in range(n):
                day += dt.timedelta(r.randrange(step))
                rows.append((v, o, day, len(rows), r.choice([1, 50, 150, 300, 500, 700, 999])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(v, o, d, i, c / 100) for v, o, d, i, c in rows], "vendor_key string, officer_id string, txn_date date, row_id long, amount double").repartition(3)


def found(df):
    return sorted(((r.vendor_key, r.officer_id, tuple(r.row_ids), round(r.total * 100)) for r in df.collect()), key=str)


@pytest.mark.parametrize(("parts", "folded"), [(None, 1024), (2, 1024), (60, 1024), (5, 1), (60, 1)])
def test_runs_wherever_a_group_is_cut(spark, monkeypatch, parts, folded):
    """The greedy rule, with as many ranges as rows (a cut at every place) and with every cluster taken by pointers."""
    monkeypatch.setattr(runs, "FOLDED", folded)
    rows = ledger(1, 15)
    assert found(runs.minimal_runs(table(spark, rows), SMALL, parts)) == greedy(rows, 1000, 14)


def test_runs_of_one_group(spark, monkeypatch):
    """One vendor and officer with all rows: several hundred overlapping candidates in one cluster, spread over ranges."""
    monkeypatch.setattr(runs, "FOLDED", 16)
    rows = [r for r in ledger(2, 700, ("a",), 2) if r[1] is None]
    want = greedy(rows, 1000, 14)
    assert len(want) > 150 and found(runs.minimal_runs(table(spark, rows), SMALL, 7)) == want


def test_runs_of_odd_rows(spark):
    """What is not above a cent, or reaches the threshold alone, is no part; an empty table has no runs."""
    rows = [("a", None, DAY, 1, 600), ("a", None, DAY, 2, 0), ("a", None, DAY, 3, -500), ("a", None, DAY, 4, 1000), ("a", None, DAY, 5, 400)]
    assert found(runs.minimal_runs(table(spark, rows), SMALL)) == [("a", None, (1, 5), 1000)]
    assert runs.minimal_runs(table(spark, rows).limit(0), SMALL).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lone_rows(text):
    """Exchanges into one partition of anything but partial sums."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and not re.search(r"partial_", lines[i + 1]):
            out.append(line)
    return out


def test_runs_have_no_python(spark):
    text = plan(runs.minimal_runs(table(spark, ledger(3, 20)), SMALL))
    assert not re.search("Python|Pandas|Arrow", text) and not lone_rows(text)


def test_running_over_range_edges(spark):
    """Ranks, sums and maxima as one task would give them, with ties of the values but not of the order."""
    r = random.Random(5)
    rows = [(r.randrange(20), i, r.choice([None, 1, 5, 9])) for i in range(300)]
    want, total, most = [], 0, None
    for n, (k, i, v) in enumerate(sorted(rows)):
        total += k
        most = v if most is None else most if v is None else max(most, v)
        want.append((k, i, v, n + 1, total, most))
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(4)
    for parts in (None, 1, 13, 200):
        got = ranks.running(df, ["k", "i"], rank="rank", sums={"total": F.col("k").cast("long")}, maxima={"most": F.col("v")}, parts=parts)
        assert sorted(map(tuple, got.select("k", "i", "v", "rank", "total", "most").collect())) == want
    assert ranks.running(df.limit(0), ["k"], rank="rank").count() == 0


def test_false_discovery_over_ranges(spark, monkeypatch):
    """The cutoff with equal p-values on either side of a range's edge, by the plain rule."""
    monkeypatch.setattr(ranks, "ranged", lambda df, order, parts=None, f=ranks.ranged: f(df, order, 9))
    r = random.Random(6)
    p = [r.choice([0.001, 0.004, 0.01, 0.02, 0.02, 0.3, 0.9]) for _ in range(80)]
    df = vendors.benjamini_hochberg(spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(p)], "vendor_key string, combined_p double"), 0.05)
    cutoff = max((x for n, x in enumerate(sorted(p), 1) if x <= 0.05 * n / len(p)), default=0.0)
    assert not lone_rows(plan(df))
    got = df.collect()
    assert len(got) == 80 and all(g.cutoff == cutoff and g.flagged == (g.combined_p <= cutoff) for g in got)
    assert vendors.benjamini_hochberg(df.select("vendor_key", "combined_p").limit(0)).count() == 0


def test_average_precision_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ranged", lambda df, order, parts=None, f=ranks.ranged: f(df, order, 9))
    r = random.Random(7)
    rows = [(r.randrange(30) / 10, r.random() < 0.3) for _ in range(400)]
    total = sum(h for _, h in rows)
    want = tp = n = 0
    for score, group in itertools.groupby(sorted(rows, reverse=True), key=lambda x: x[0]):
        hits = [h for _, h in group]
        n, tp = n + len(hits), tp + sum(hits)
        want += tp / n * sum(hits) / total
    df = evaluate.average_precision(spark.createDataFrame(rows, "score double, hit boolean"), total)
    assert not lone_rows(plan(df)) and df.first().ap == pytest.approx(want, abs=1e-9)
