"""Mixing sources to target weights by hash-threshold histograms.

Sizes are words. A document's hash orders its source's documents; the mix takes whole passes over a source and then those documents whose hash lies at or below the source's threshold.
The threshold comes from nested histograms: words are summed by source and the top BITS bits of the hash, the bucket in which the budget ends is found, and only that bucket is summed again by the next BITS bits, until all LEVELS are used. Nothing is sorted by hash; a level's state is at most 2**BITS sums a source.
Documents that share the whole boundary hash (repeated doc_ids) are taken together if that brings the sum nearer to the target.

Cases: null text or no words is size 0; null source is a source of its own, ordered last; a null doc_id hashes as the text 'null'; repeated rows count each; an empty table gives no rows; a source with no words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, raw, small, written

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes: 150 %
MOST = 2  # times a source's size
HASH_DIGITS = 12  # hexadecimal digits of MD5: 48 bits
BITS, LEVELS = 12, 4


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n = [len(t.split()) for t in raw(b.column("text"))]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "source": b.column("source"), "size": pa.array(n, pa.int64())})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row a source. The targets fill like water: a source whose share by weight exceeds MOST times its size stops there and the rest is shared anew.

    With sources ordered by MOST * size / weight, those that stop are a prefix: the longest whose members all stop when the rest is shared among the sources not before them.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * MOST)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    num, den = SHARE
    left = F.sum("source_size").over(everything) * num - F.coalesce(F.sum("cap").over(before), F.lit(0)) * den  # times den
    by = by.withColumn("left", left).withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    stops = F.col("cap") * den * F.col("w_left") <= F.col("left") * F.col("w")
    by = by.withColumn("stop", stops).withColumn("run", F.min(F.col("stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = lambda c: F.min_by(c, F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("source").isNull().alias("n"), F.col("source").alias("s"))).over(Window.partitionBy("run"))
    share = (F.col("w") * first("left")).cast("double") / (first("w_left") * den).cast("double")
    return by.select("source", "source_size", F.when(F.col("run"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of docs; taken = copies * size. Rows of one doc_id and source are taken alike."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = known.mapInArrow(_sizes, "doc_id long, source string, size long")
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, HASH_DIGITS)
    sizes = written(sizes.withColumn("h", F.conv(digits, 16, 10).cast("long")), "sizes")
    goal = written(targets(sizes, weights), "targets")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("passes", passes)
    # at: the prefix of the hash found so far; used: words below it; need: words wanted below the threshold
    found = goal.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("used"))
    for level in range(LEVELS):
        low = HASH_DIGITS * 4 - BITS * (level + 1)
        inside = sizes.join(found, sizes["source"].eqNullSafe(found["source"])).where(F.shiftright("h", low + BITS) == F.col("at"))
        sums = inside.groupBy(sizes["source"], F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("used").alias("used"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("used") + F.sum("words").over(run))
        # The boundary is the first bucket that ends beyond the need; without one everything is below.
        beyond = F.col("upto") > F.col("need")
        found = sums.groupBy("source").agg(
            F.first("need").alias("need"),
            F.coalesce(F.min(F.when(beyond, F.col("bucket"))), F.max("bucket")).alias("at"),
            F.coalesce(F.min(F.when(beyond, F.col("upto") - F.col("words"))), F.max(F.col("upto") - F.col("words"))).alias("used"),
            F.coalesce(F.min(F.when(beyond, F.col("words"))), F.max_by("words", "bucket")).alias("words"),
        )
        found = written(found, f"level{level}")
    # The last bucket is one hash: with it or without, whichever is nearer.
    nearer = F.abs(F.col("used") + F.col("words") - F.col("need")) <= F.abs(F.col("need") - F.col("used"))
    edge = found.select("source", F.when((F.col("need") > 0) & nearer, F.col("at")).otherwise(F.col("at") - 1).alias("upto"))
    plan = goal.join(edge, goal["source"].eqNullSafe(edge["source"]), "left").select(goal["source"].alias("s"), "source_size", "target", "passes", "upto")
    out = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"]), "left")
    extra = (F.col("h") <= F.col("upto")) & (F.col("passes") < MOST)
    copies = F.col("passes") + F.when(extra, 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), sizes["source"])


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("copies", "source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2 AS cap, row_number() OVER (ORDER BY source_size * 2 / w, source NULLS LAST) AS k FROM s),
b AS (SELECT *, (sum(source_size) OVER () * 3 - 2 * coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l,
             (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wl FROM c),
e AS (SELECT *, coalesce((SELECT min(k) FROM b WHERE cap * 2 * wl > l * w), 1000000000) AS k1 FROM b),
t AS (SELECT source, source_size, CASE WHEN k < k1 THEN cap::DOUBLE ELSE (w * (SELECT l FROM e x WHERE x.k = x.k1))::DOUBLE / ((SELECT wl FROM e x WHERE x.k = x.k1) * 2)::DOUBLE END AS target FROM e),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS passes FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((passes + CASE WHEN passes < 2 AND need > 0 AND (upto <= need OR (upto - own <= need AND upto - need <= need - (upto - own))) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
