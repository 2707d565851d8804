"""Whole vectors of a table as exact integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
#: float64 holds integers below it; sums of products that stay below it are exact whatever their order.
WHOLE = 1 << 53


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vectors(table: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, v: the vectors, as doubles, that hold no null or non-finite component, and of dim components where that is given."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return rows if dim is None else rows.where(F.size("v") == dim)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): integers in float64 where it holds them exactly, else Python's."""
    with np.errstate(over="ignore"):
        y = x * scale
    if not y.size or np.abs(y).max() < WHOLE:
        return np.floor(y)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 52 else int(np.floor(v * scale))  # noqa: E731  from 2**52 on a double has no fraction
    return np.array([whole(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def clipped(x: np.ndarray, most: int = LONG) -> np.ndarray:
    """Integers as longs; what is beyond counts as the largest or the least."""
    return x.astype(np.int64) if x.dtype != object else np.array([max(-most, min(most, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)
