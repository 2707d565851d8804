"""Statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def first_digit(x: Column) -> Column:
    return F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int")


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution with an even number of degrees."""
    h, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


#: Steps of the continued fraction: enough for any shape up to a thousand million trials; beyond, its end is that of so many.
MOST_STEPS = 1 << 19


def stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's ln(sqrt(2 pi n) (n / e)^n): a table of exact values up to 15, a series beyond."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) if i else 0.0) for i in range(16)])
    x = n.cast("double")
    nn = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * nn)) / nn) / nn) / nn) / x
    return F.when(n > 15, series).otherwise(F.element_at(table, (F.least(n, F.lit(15)) + 1).cast("int")))


def binomial_share(k: Column, n: Column, p: Column) -> Column:
    """P(X = k) for 0 <= k <= n and 0 < p < 1, by the saddle point's deviance, so that large numbers do not cancel."""

    def deviance(x: Column, mean: Column) -> Column:
        d = (mean - x) / x
        return x * (d - F.log1p(d))

    kd, nd = k.cast("double"), n.cast("double")
    rest = nd - kd
    inner = F.exp(stirling_rest(n) - stirling_rest(k) - stirling_rest(n - k) - deviance(kd, nd * p) - deviance(rest, nd * (1 - p))) * F.sqrt(nd / (2 * math.pi * kd * rest))
    return F.when(k <= 0, F.exp(nd * F.log1p(-p))).when(k >= n, F.exp(nd * F.log(p))).otherwise(inner)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for 0 < p < 1: the regularised incomplete beta function of p at (k, n - k + 1), by its continued fraction from the side on which that converges, in at most 80 + 16 sqrt(n) half steps."""
    a, b = k.cast("double"), (n - k + 1).cast("double")
    left = p <= (a + 1) / (a + b + 2)
    x, s, t = F.when(left, p).otherwise(1 - p), F.when(left, a).otherwise(b), F.when(left, b).otherwise(a)
    front = F.when(left, binomial_share(k, n, p) * (1 - p)).otherwise(binomial_share(k - 1, n, p) * p)

    def factor(i: Column, v: Column) -> Column:
        """The i-th numerator, i from 1 on."""
        m = F.floor(i / 2).cast("double")
        even = m * (v["t"] - m) * v["x"] / ((v["s"] + 2 * m - 1) * (v["s"] + 2 * m))
        odd = -(v["s"] + m) * (v["s"] + v["t"] + m) * v["x"] / ((v["s"] + 2 * m) * (v["s"] + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd)

    def step(v: Column, i: Column) -> Column:
        f = factor(i, v)
        over = 1 / (1 + f * v["d"])
        c = F.when(i == 1, F.lit(1.0)).otherwise(1 + f / v["c"])
        same = {name: v[name].alias(name) for name in ("x", "s", "t")}
        return F.struct(*same.values(), c.alias("c"), over.alias("d"), (v["h"] * over * c).alias("h"))

    one = F.lit(1.0)
    start = F.struct(x.alias("x"), s.alias("s"), t.alias("t"), one.alias("c"), one.alias("d"), one.alias("h"))
    steps = F.least(F.lit(MOST_STEPS), 80 + F.ceil(16 * F.sqrt(n.cast("double")))).cast("int")
    part = front * F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda v: v["h"])
    tail = F.when(left, part).otherwise(1 - part)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's 95 % interval of a share, within 0 and 1; null without trials."""
    n, zz = F.nullif(n, F.lit(0)), z * z
    p = k / n
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    inside = lambda x: F.when(n.isNotNull(), F.greatest(F.least(x / (1 + zz / n), F.lit(1.0)), F.lit(0.0)))
    return inside(centre - half), inside(centre + half)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def exact_medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, median of each group; see exact_ranks()."""
    return exact_ranks(df, value, by, {"median": (0.5, "middle")})


def exact_ranks(df: DataFrame, value: str, by: list[str], wanted: dict[str, tuple[float, str]], accuracy: int = 10_000) -> DataFrame:
    """by, n and a value of each wanted rank (its share, and how it is read: 'middle', the mean of the two ranks around (n - 1) / 2, or 'nearest', the rank round(share * (n - 1)), half to even) of each group: exact, without a task that holds all of a group's values.

    A sketch brackets each share, four times as wide as the sketch may err by (1 / accuracy of the ranks). Values outside the brackets count as one between each two of them, and those within, about 8 / accuracy of all, are counted by value and ranked. Sketch and counts are combined before they are shuffled.
    """
    shares = sorted(wanted.values())
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    brackets: list[list[float]] = []
    for low, high in sorted((max(0.0, p - 4 / accuracy), min(1.0, p + 4 / accuracy)) for p, _ in shares):
        if brackets and low <= brackets[-1][1]:
            brackets[-1][1] = max(high, brackets[-1][1])
        else:
            brackets.append([low, high])
    cuts = [c for b in brackets for c in b]
    edge = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", cuts, accuracy).alias("b"))
    joined = rows.join(edge, by) if by else rows.crossJoin(F.broadcast(edge))  # one row
    # An even number of cuts below, or all of them: outside every bracket. Such values count as the cut that ends their stretch.
    below = F.size(F.filter("b", lambda x: x < F.col("v")))
    at_edge = F.array_contains("b", F.col("v"))
    place = F.when((below % 2 == 0) & ~at_edge, F.coalesce(F.try_element_at("b", below + 1), F.lit(float("inf")))).otherwise(F.col("v"))
    first = F.when((below % 2 == 0) & ~at_edge, 0).otherwise(1)
    counted = joined.select(*by, "n", place.alias("v"), first.alias("in")).groupBy(*by, "n", "v", "in").agg(F.count("*").alias("m"))
    ranked = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("v", "in").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    read = {
        k: [at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))] if how == "middle" else [at(F.bround(p * (F.col("n") - 1))), at(F.bround(p * (F.col("n") - 1)))] for k, (p, how) in wanted.items()
    }
    return ranked.groupBy(*by, "n").agg(*[((a + b) / 2).alias(k) for k, (a, b) in read.items()])
