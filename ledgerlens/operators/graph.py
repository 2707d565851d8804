"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed, cleaned, discard, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, root (the least id reachable) of every end of edges (a, b).

    Where each edge leads from a group's least id, as edges of exact matches do, the groups are read off the edges. Else, in a round each id takes the least root among its neighbours' and its own, and then that root's root, so paths halve. Rounds end when nothing moves; each is cut by a reliable checkpoint, and the driver sees one bit of it.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root"))
    near = written(down.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("most")), "near")
    tops = near.select("root").distinct()
    with cleaned(edges.sparkSession):
        settled = near.where("root <> most").isEmpty() and near.join(tops.withColumnRenamed("root", "id"), "id", "left_semi").isEmpty()
    if settled:
        out = written(near.select("id", "root").union(tops.select("root", "root")), "roots")
        discard(near)
        return out
    discard(near)
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    at = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        seen = both.join(at.select(F.col("id").alias("b"), F.col("root").alias("theirs")), "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        step = at.join(seen, "id").select("id", "root", F.least("root", "theirs").alias("to"))
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = checkpointed(step.join(jump, "to", "left").select("id", F.col("root").alias("was"), F.least("to", F.coalesce("far", "to")).alias("root")))
        at = step.select("id", "root")
        if step.where("root <> was").isEmpty():
            return at
    raise RuntimeError("components did not settle")
