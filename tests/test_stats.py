import random
import time
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import stats


def exact(k, n, p):
    """The sum itself, in sixty digits."""
    getcontext().prec = 60
    p = Decimal(p)
    q, term, total = 1 - p, (1 - p) ** n, Decimal(0)
    for i in range(n + 1):
        if i >= k:
            total += term
            if term < total * Decimal("1e-30") and i > n * p:
                break
        term = term * (n - i) / (i + 1) * p / q
    return float(total)


def tails(spark, rows):
    df = spark.createDataFrame(rows, "k long, n long, p double")
    return [r.t for r in df.select(stats.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()]


def test_binomial_tail_is_the_sum(spark):
    r = random.Random(1)
    rows = [(k, n, p) for n in (1, 2, 7, 20) for k in range(n + 2) for p in (1e-6, 0.2, 0.5, 0.97)]
    for n in (60, 700, 5000, 100_000):
        for p in (0.003, 0.11, 0.5, 0.9):
            sd = (n * p * (1 - p)) ** 0.5
            rows += [(min(n, max(0, round(n * p + z * sd))), n, p) for z in (-6, -1, -0.1, 0, 0.1, 1, 3, 7)]
    rows = r.sample(rows, len(rows))
    for (k, n, p), t in zip(rows, tails(spark, rows), strict=True):
        assert t == pytest.approx(exact(k, n, p), abs=1e-10), (k, n, p)


def test_small_tails_keep_their_digits(spark):
    rows = [(90, 100, 0.2), (400, 2000, 0.1), (12, 20, 0.01)]
    assert tails(spark, rows) == pytest.approx([exact(*x) for x in rows], rel=1e-10)


def test_binomial_tail_of_very_many_trials(spark):
    """The right limits, and the middle, at a thousand million trials, without a step a trial."""
    n = 10**9
    began = time.time()
    low, mid, high, far = tails(spark, [(299_000_000, n, 0.3), (300_000_000, n, 0.3), (301_000_000, n, 0.3), (n, n, 0.3)])
    assert low == pytest.approx(1, abs=1e-12) and high < 1e-12 and far == 0
    assert mid == pytest.approx(0.5, abs=1e-4)
    assert time.time() - began < 30
