import random

import pytest

from ledgerlens.operators import explore


def plain(rows, k, most):
    out = set()
    for i, g, v in rows:
        if g is None:
            continue
        near = sorted((abs(w - (0.0 if v is None else v)), j) for j, h, w in rows if h == g and w is not None and j != i)
        out |= {(i, n, j, d) for n, (d, j) in enumerate([x for x in near if most is None or x[0] <= most][:k], 1)}
    return out


@pytest.mark.parametrize(("stretch", "k", "most"), [(8, 3, None), (4096, 3, 2.0), (6, 1, None)])
def test_nearest_across_stretches(spark, stretch, k, most):
    """Groups cut at many places, one value that most rows share, rows without value or group, a lone row."""
    r = random.Random(stretch)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 0.0, 5.0, 5.0, 5.0, -1.0, r.randrange(40) / 4])) for i in range(150)]
    rows += [(200 + i, "hot", 7.0) for i in range(60)] + [(300, "lone", 1.0), (301, "bare", None)]
    df = spark.createDataFrame(rows, "row_id long, g string, v double").repartition(3)
    got = explore.nearest(df, "g", "v", k, most, stretch).collect()
    assert {tuple(x) for x in got} == plain(rows, k, most) and len(got) == len(plain(rows, k, most))


def test_no_task_holds_a_value(spark):
    """Of a table with one category and one price what is sent on, after the first count of the least ids, is one line."""
    df = spark.range(5000).selectExpr("id AS row_id", "concat('c', id % 1) AS g", "1.0D + id % 1 AS v")
    out = explore.nearest(df, "g", "v", 2)
    got = {(x.row_id, x.rank): x.near_id for x in out.where("row_id in (0, 1, 2, 4999)").collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 0, (2, 2): 1, (4999, 1): 0, (4999, 2): 1}
    assert "WindowGroupLimit" in _plans(df)


def _plans(df):
    """The plan of the least ids of each value, which keeps them before rows are sent."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("g", "v").orderBy("row_id")
    return df.withColumn("_n", F.row_number().over(w)).where("_n <= 3")._jdf.queryExecution().executedPlan().toString()
