"""The case: what every detector returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.text import uuid5

# Fixed value: the name space of case ids.
NAMESPACE = "7a1c4e523b9d4f0a9c615e2d8b0f1a34"


def severity(score: Column, at_risk: Column, t: Thresholds = DEFAULT) -> Column:
    share = F.least(F.log1p(F.greatest(at_risk, F.lit(0.0))) / math.log1p(t.severity_reference), F.lit(1.0))
    return F.round(100 * score * share, 2)


def band(severity: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(severity >= t.band_high, "high").when(severity >= t.band_medium, "medium").otherwise("low")


def build(df: DataFrame, detector: str, kind: str, t: Thresholds = DEFAULT, metadata: dict[str, Column] | None = None) -> DataFrame:
    """Cases from row_ids, score, at_risk and vendor_key; the id follows from detector, kind and rows. metadata: what else the detector says, kept as JSON."""
    ids = F.array_sort(F.array_distinct("row_ids"))
    identity = F.concat(F.lit(f"{detector}|{kind}|"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
    s = severity(F.col("score"), F.col("at_risk"), t)
    more = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()])) if metadata else F.lit("{}")
    return df.select(
        uuid5(NAMESPACE, identity).alias("case_id"), F.lit(kind).alias("anomaly_type"), F.lit(detector).alias("detector"), ids.alias("row_ids"), F.col("score").cast("double").alias("detector_score"),
        F.col("at_risk").cast("double").alias("amount_at_risk"), s.alias("severity_prelim"), band(s, t).alias("band"), F.col("vendor_key"), more.alias("metadata"),
    )
