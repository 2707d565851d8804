"""Band joins: pairs of rows close in amount and date, as an equi-join on neighbouring buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


#: A cell of the band is so many amount buckets wide, and some CELL_DAYS long; a task of the join gets TASK_BYTES of the table's files.
CELL, CELL_DAYS, TASK_BYTES = 8, 120, 2 << 20
STEPS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def tasks(rows: DataFrame) -> int:
    """How many tasks rows are dealt to: the session's shuffle partitions, more for a large stored table."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES) if size < 1 << 42 else 1)


def _buckets(tolerance: float, days: tuple[int, int]) -> tuple[F.Column, F.Column]:
    """The amount's and the date's bucket of a row: a pair of the band is in one bucket or in neighbours."""
    return F.floor(F.log("amount") / -math.log1p(-tolerance)).cast("int"), F.floor(F.datediff("txn_date", F.lit("1970-01-01").cast("date")) / (days[1] + 1)).cast("int")


def at_most(rows: DataFrame, tolerance: float = DEFAULT.dup_tolerance, days: tuple[int, int] = (0, DEFAULT.dup_days)) -> int:
    """No fewer than the pairs of the band: those of rows in one bucket or in neighbours. Rows are counted by bucket, none is paired."""
    a, d = _buckets(tolerance, days)
    n = rows.where("amount > 0").groupBy(a.alias("_ab"), d.alias("_db")).agg(F.count("*").cast("decimal(20,0)").alias("n"))
    met = F.inline(F.array(*[F.struct((F.col("_ab") + x).alias("_ab"), (F.col("_db") + y).alias("_db")) for x, y in STEPS]))
    other = n.select(F.col("n").alias("m"), met)
    return int(n.join(other, ["_ab", "_db"]).agg(F.sum(F.col("n") * F.col("m")).cast("decimal(38,0)")).first()[0] or 0)


def band(rows: DataFrame, tolerance: float = DEFAULT.dup_tolerance, days: tuple[int, int] = (0, DEFAULT.dup_days), same: tuple[str, ...] = (), some: F.Column | None = None) -> DataFrame:
    """Pairs of rows, in no order of the two (p_*, q_*), whose amounts differ by less than tolerance of the larger and whose dates are days[0]..days[1] apart (gap). same: columns in which both agree. some: which rows may be p, by default all; each pair has one that is.

    Amount buckets are so wide that a pair is in one or two neighbours, date buckets are days[1] + 1 days. Of a bucket's eight neighbours one side is copied to four, so that every pair meets once; within a bucket the lesser row_id comes first. Rows are shuffled by cells of many buckets, and the copies are made within a cell, so that what travels twice is only the rows at a cell's edge. Both sides read rows, so a view of several tables should be stored first, with the columns that are wanted.
    """
    length = max(2, CELL_DAYS // (days[1] + 1))
    parts = tasks(rows)
    # Both sides are dealt by cell, and joined by cell and bucket: without this they would be dealt once more, copies and all.
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = rows.where("amount > 0")
    a, d = _buckets(tolerance, days)
    cell = lambda x, y: F.struct(F.floor(x / CELL).cast("int").alias("_ca"), F.floor(y / length).cast("int").alias("_cd"))
    keys = {f"_s{i}": F.col(c) for i, c in enumerate(same)}
    dealt = [*keys, "_ca", "_cd"]
    home = (rows if some is None else rows.where(some)).withColumns(keys).withColumn("_c", cell(a, d)).select("*", "_c.*").drop("_c").repartition(parts, *dealt)
    left = home.select(*[F.col(c).alias(f"p_{c}") for c in rows.columns], *dealt, a.alias("_ab"), d.alias("_db"))
    met = F.explode(F.array_distinct(F.array(*[cell(a + x, d + y) for x, y in STEPS])))
    copies = rows.withColumns(keys).withColumn("_c", met).select("*", "_c.*").drop("_c").repartition(parts, *dealt)
    steps = F.explode(F.array(*[F.struct((a + x).alias("_ab"), (d + y).alias("_db"), F.lit(x == y == 0).alias("_home")) for x, y in STEPS])).alias("_to")
    right = copies.select(*[F.col(c).alias(f"q_{c}") for c in rows.columns], *dealt, steps).where((F.floor(F.col("_to._ab") / CELL) == F.col("_ca")) & (F.floor(F.col("_to._db") / length) == F.col("_cd")))
    right = right.select("*", "_to.*").drop("_to")
    gap = F.abs(F.datediff("p_txn_date", "q_txn_date"))
    near = F.abs(F.col("p_amount") - F.col("q_amount")) < tolerance * F.greatest("p_amount", "q_amount")
    once = ~F.col("_home") | (F.col("p_row_id") < F.col("q_row_id"))
    pairs = left.join(right, [*dealt, "_ab", "_db"]).where(once & near & gap.between(*days) & (F.col("p_row_id") != F.col("q_row_id")))
    return pairs.withColumn("gap", gap).drop(*dealt, "_ab", "_db", "_home")


def amount_pairs(tx: DataFrame, tolerance: float = DEFAULT.dup_tolerance, days: tuple[int, int] = (0, DEFAULT.dup_days), same: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of the band as a_* and b_*, the lesser row_id first."""
    first = F.col("p_row_id") < F.col("q_row_id")
    side = lambda x, y, name: [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{name}_{c}") for c in tx.columns]
    return band(tx, tolerance, days, same).select(*side("p", "q", "a"), *side("q", "p", "b"), "gap")
