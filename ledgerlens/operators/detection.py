"""All detectors as one run over a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.scratch import written
from . import baseline, duplicates, prices, runs, vendors

REGISTRY: dict[str, Callable[[DataFrame, Thresholds], DataFrame]] = {"baseline": baseline.detect, "d1": duplicates.detect, "d2": runs.detect, "d3": prices.detect, "d4": vendors.detect}
PRODUCTION = ("d1", "d2", "d3", "d4")


class PlantedDataError(RuntimeError):
    """The table holds planted anomalies; its findings are no findings."""


def run_detection(tx: DataFrame, detectors: Sequence[str] = PRODUCTION, t: Thresholds = DEFAULT, planted: bool = False) -> DataFrame:
    """Cases of every detector named, of one shape. planted: whether the table is an evaluation's, which is refused."""
    if unknown := [d for d in detectors if d not in REGISTRY]:
        raise KeyError(f"unknown detectors {unknown}; there are {sorted(REGISTRY)}")
    if planted:
        raise PlantedDataError("planted anomalies are for evaluation, not for the queue of cases")
    tx, out = written(tx, "audited"), None  # a view of several tables is joined once
    for name in detectors:
        found = REGISTRY[name](tx, t)
        out = found if out is None else out.unionByName(found)
    return out


def summary(cases: DataFrame) -> DataFrame:
    """Cases, rows and money of each detector."""
    return cases.groupBy("detector").agg(F.count("*").alias("n_cases"), F.sum(F.size("row_ids")).alias("n_rows"), F.sum(F.col("amount_at_risk").cast("decimal(24,4)")).cast("double").alias("at_risk"))


def clean_check(cases: DataFrame, detectors: Sequence[str] = PRODUCTION) -> DataFrame:
    """What each detector flags in data with nothing planted: cases and distinct rows, zeros included."""
    spark = cases.sparkSession
    every = spark.createDataFrame([(d,) for d in detectors], "detector string")
    rows = cases.select("detector", F.explode("row_ids").alias("row_id")).groupBy("detector").agg(F.count_distinct("row_id").alias("n_rows"))
    n = cases.groupBy("detector").agg(F.count("*").alias("n_cases"))
    return every.join(n, "detector", "left").join(rows, "detector", "left").fillna(0, ["n_cases", "n_rows"])


def fingerprint(cases: DataFrame) -> DataFrame:
    """One row that two runs share only if they found the same cases with the same scores: a sum of hashes that no order changes."""
    h = F.xxhash64("case_id", F.round("detector_score", 12)).cast("decimal(20,0)")
    return cases.agg(F.count("*").alias("n_cases"), F.sum(h).cast("string").alias("fingerprint"))
