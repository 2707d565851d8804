"""Tables kept by key: newest rows, upserts, and the queue of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """new over old by key; columns in keep stay as they were where the key was there."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    seen, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    return both.select(*[(F.coalesce(f"o.{c}", f"n.{c}") if c == key else F.when(seen & (F.lit(c in keep) | ~fresh), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in old.columns])
