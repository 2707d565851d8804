"""Ranks, running sums and running maxima over a whole table's order, without a task that sees the whole table.

Rows are dealt to ranges of the order, each range is summed, and what all earlier ranges hold is added to the sums within a range. What the driver holds is one line of sums a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written

PART = "_part"


def ranged(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df, stored, with the number of the range that each row is in (_part): what is in a range comes before all that is in the next. Rows of equal order are in one range. parts: the number of ranges; by default as many as the session's partitions, fewer for little data."""
    rows = written(df, "unranged")  # dealing to ranges reads its input twice, first for a sample of the order
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    out = written(dealt.withColumn(PART, F.spark_partition_id()), "ranged")
    discard(rows)
    return out


def running(df: DataFrame, order: list[Column | str], rank: str | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, parts: int | None = None, edges: bool = False) -> DataFrame:
    """df with the place of each row from 1 on (rank) and the running sums and maxima up to each row, itself included. order must tell rows apart, or what rows of equal order get is up to chance; sums are of integers or decimals, maxima ignore nulls. edges: keeps the range's number, and of each sum what is before the range and up to its end (_before_*, _upto_*)."""
    columns = dict(sums or {}) | ({rank: F.lit(1).cast("long")} if rank else {})
    latest = maxima or {}
    rows = ranged(df.withColumns(columns | latest), order, parts)
    w = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = carried(rows, w, [*columns], [*latest], edges)
    return out if edges else out.drop(PART)


def _placed(x) -> tuple:
    """Where a value lies among others as Spark orders them: null first, a struct field by field."""
    return (0,) if x is None else (1, tuple(map(_placed, x))) if isinstance(x, tuple) else (1, x)


def carried(rows: DataFrame, w: Window, sums: list[str], maxima: list[str] | None = None, edges: bool = False) -> DataFrame:
    """Running sums and maxima of columns of a ranged table in place of these, by a window over each range."""
    maxima = maxima or []
    by = rows.groupBy(PART).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
    before, lines = {c: 0 for c in sums} | {c: None for c in maxima}, []
    for r in sorted(by.collect(), key=lambda r: r[PART]):  # one line a range
        lines.append([r[PART], *(before[c] for c in (*sums, *maxima))])
        before |= {c: before[c] + (r[c] or 0) for c in sums} | {c: max((before[c], r[c]), key=_placed) for c in maxima}
        lines[-1] += [before[c] for c in sums]
    kinds = {f.name: f.dataType.simpleString() for f in by.schema}
    held = rows.sparkSession.createDataFrame(lines, ", ".join([f"{PART} int", *(f"_before_{c} {kinds[c]}" for c in (*sums, *maxima)), *(f"_upto_{c} {kinds[c]}" for c in sums)]))
    own = {c: F.sum(c).over(w) for c in sums} | {c: F.max(c).over(w) for c in maxima}
    out = rows.withColumns(own).join(F.broadcast(held), PART)  # one line a range
    whole = {c: F.col(c) + F.col(f"_before_{c}") for c in sums} | {c: F.greatest(c, f"_before_{c}") for c in maxima}
    out = out.withColumns(whole)
    return out if edges else out.drop(*[f"_before_{c}" for c in (*sums, *maxima)], *[f"_upto_{c}" for c in sums])
