"""Isolation forest: a second opinion on prices, never a finding of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.stats import exact_ranks
from ..sources.scratch import written

FEATURES = ("rel", "lq", "vendor_share", "days")
TREES, HELD = 200, 256


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a value is found in a random tree of n values."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: of each node the feature and cut, its lesser child, and the depth credited to what ends there."""

    def __init__(self, samples: list[np.ndarray], seed: int):
        self.trees = [self._grow(x, np.random.default_rng([seed, i])) for i, x in enumerate(samples)]
        self.limit = int(np.ceil(np.log2(max((2, *map(len, samples))))))
        self.scale = float(expected_path(max((len(x) for x in samples), default=1)))

    @staticmethod
    def _grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        feature, cut, child, depth = [], [], [], []

        def node() -> int:
            for column, empty in ((feature, -1), (cut, 0.0), (child, -1), (depth, 0.0)):
                column.append(empty)
            return len(feature) - 1

        todo = [(node(), x, 0)]
        while todo:
            at, rows, d = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if d >= limit or len(rows) < 2 or not len(open_):
                depth[at] = d + float(expected_path(len(rows)))
                continue
            f = int(rng.choice(open_))
            c = float(rng.uniform(low[f], high[f]))
            less = rows[:, f] <= c
            first = node()
            node()
            feature[at], cut[at], child[at] = f, c, first
            todo += [(first, rows[less], d + 1), (first + 1, rows[~less], d + 1)]
        return np.array(feature), np.array(cut), np.array(child), np.array(depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Minus two to the power of minus the mean depth over the expected one: the lower, the more apart."""
        total, row, flat = np.zeros(len(x)), np.arange(len(x)), np.ascontiguousarray(x.T).ravel()
        for feature, cut, child, depth in self.trees:
            # What ends at a node stays there, as nothing is above its cut.
            ends = child < 0
            at_feature, at_cut, at_child = np.where(ends, 0, feature) * len(x), np.where(ends, np.inf, cut), np.where(ends, np.arange(len(child)), child)
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                at = at_child[at] + (flat[at_feature[at] + row] > at_cut[at])
            total += depth[at]
        return -np.power(2.0, -total / max(1, len(self.trees)) / max(self.scale, 1e-12))


def second_opinion(scored: DataFrame, contamination: float = 0.02, seed: int = 42, trees: int = TREES, held: int = HELD) -> DataFrame:
    """Scored rows with forest_score and forest_outlier, the share contamination of rows that lie most apart. scored: of prices.scores().

    Each tree is grown from held rows by the least draws, so trees * held rows of four numbers reach the driver at most, whatever the table holds; all rows are scored where they are.
    """
    # Stored, as three passes go over the rows and three over the scores.
    rows = written(scored.select("row_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]), "features")
    n = rows.count()
    if not n:
        return scored.withColumns({"forest_score": F.lit(None).cast("double"), "forest_outlier": F.lit(False)})
    # A tree's rows are the least draws of about twice as many as are held. In a large table a row is drawn once, and what is drawn is dealt to the trees; in a small one it is drawn for every tree.
    pool = 2 * held + 50
    if n >= trees * pool:
        drawn = rows.withColumn("u", draw(seed, "forest", F.col("row_id"), F.lit(-1))).where(F.col("u") < trees * pool / n)
        drawn = drawn.withColumn("tree", F.floor(draw(seed, "forest", F.col("row_id"), F.lit(-2)) * trees).cast("int"))
    else:
        drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("u", draw(seed, "forest", F.col("row_id"), F.col("tree"))).where(F.col("u") < min(1.0, pool / n))
    w = Window.partitionBy("tree").orderBy("u", "row_id")
    sample = drawn.withColumn("at", F.row_number().over(w)).where(F.col("at") <= held).select("tree", "at", *FEATURES).toPandas().sort_values(["tree", "at"])
    forest = scored.sparkSession.sparkContext.broadcast(Forest([g[list(FEATURES)].to_numpy() for _, g in sample.groupby("tree")], seed))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"row_id": f["row_id"], "forest_score": forest.value.scores(f[list(FEATURES)].to_numpy()).round(4)})

    scores = written(rows.mapInPandas(work, "row_id long, forest_score double"), "forest")
    bound = exact_ranks(scores, "forest_score", [], {"bound": (contamination, "nearest")}).select("bound")
    return scored.join(scores, "row_id").crossJoin(F.broadcast(bound)).withColumn("forest_outlier", F.col("forest_score") < F.col("bound")).drop("bound")  # one row


def gap(judged: DataFrame, z: float) -> DataFrame:
    """How many rows only the z-score, only the forest, and both set apart."""
    high, out = F.col("z") >= z, F.col("forest_outlier")
    return judged.agg(F.count_if(high & ~out).alias("z_only"), F.count_if(~high & out).alias("forest_only"), F.count_if(high & out).alias("both"))
