"""Split purchases: shortest runs of a vendor and officer that reach the approval threshold within the window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.scratch import discard, written
from . import cases
from .ranks import PART, carried, running

#: Share of each component in a run's score.
WEIGHTS = {"window": 0.25, "homogeneity": 0.25, "single_rate": 0.25, "parts": 0.25}
POLICY_CLAUSES = ("SG-PP-3.2", "SG-PP-3.3")


#: Clusters of overlapping candidates of at most so many are folded as one array; longer ones by pointers.
FOLDED = 1024


def numbered(tx: DataFrame, limit: int, days: int, parts: int | None = None) -> DataFrame:
    """Parts of purchases in one order, stored: g, the place of a row; cum, the running sum of cents over the whole table; s, where the shortest stretch ends that reaches back from the row to the limit, if it is in the row's range, of its vendor and officer and within the days; ask, rows whose stretch begins in an earlier range; tail, rows of a range in which such a stretch may begin."""
    cents = (F.col("amount").cast("decimal(18,2)") * 100).cast("long")
    rows = tx.select("vendor_key", "officer_id", "txn_date", "row_id", cents.alias("cents")).where((F.col("cents") > 0) & (F.col("amount") < limit / 100))
    order = ["vendor_key", "officer_id", "txn_date", "row_id"]
    rows = running(rows, order, rank="g", sums={"cum": F.col("cents")}, parts=parts, edges=True)
    by_place = Window.partitionBy(PART).orderBy(*order)
    reached = Window.partitionBy(PART).orderBy("cum").rangeBetween(Window.unboundedPreceding, -limit)
    me, want, base = F.struct("g", "vendor_key", "officer_id", "txn_date"), F.col("cum") - limit, F.col("_before_cum")
    rows = rows.withColumns({"after": F.lead(me).over(by_place), "first": F.first(me).over(by_place)})
    # The stretch begins after the last row whose sum is at most what must be left out.
    rows = rows.withColumn("from", F.coalesce(F.last("after").over(reached), F.when(base <= want, F.col("first"))))
    ask = (want >= 0) & (want < base)
    out = rows.withColumns({"s": F.when(~ask & reaches("from", days), F.col("from.g")), "ask": ask, "tail": F.col("cum") > F.col("_upto_cum") - limit})
    out = written(out.select(PART, "g", "cum", "vendor_key", "officer_id", "txn_date", "row_id", "cents", "s", "ask", "tail"), "numbered")
    discard(rows)
    return out


def reaches(start: str, days: int) -> F.Column:
    """Whether a stretch from start is of the row's vendor and officer and within the days."""
    a = F.col(start)
    return (a["vendor_key"] == F.col("vendor_key")) & a["officer_id"].eqNullSafe(F.col("officer_id")) & (F.datediff("txn_date", a["txn_date"]) <= days)


def across(rows: DataFrame, limit: int, days: int, parts: int | None = None) -> DataFrame:
    """_part, g, s of the rows whose stretch begins in an earlier range: the asked sums and the sums before each row of the ranges' tails in one order, the last such row carried along."""
    me = F.struct("g", "vendor_key", "officer_id", "txn_date")
    asked = rows.where("ask").select((F.col("cum") - limit).alias("at"), F.lit(1).alias("kind"), PART, "g", "vendor_key", "officer_id", "txn_date")
    held = rows.where("tail").select((F.col("cum") - F.col("cents")).alias("at"), F.lit(0).alias("kind"), PART, "g", "vendor_key", "officer_id", "txn_date")
    both = asked.unionByName(held).withColumnRenamed(PART, "of")
    found = running(both, ["at", "kind", "g"], maxima={"from": F.when(F.col("kind") == 0, me)}, parts=parts)
    return found.where((F.col("kind") == 1) & reaches("from", days)).select(F.col("of").alias(PART), "g", F.col("from.g").alias("s"))


def clustered(found: DataFrame) -> DataFrame:
    """g, s, cluster of the candidates. A candidate that begins after the one before it ended begins a cluster; what is taken in one does not depend on another. s never falls as g rises."""
    w = Window.partitionBy(PART).orderBy("g")
    before = F.lag("g").over(w)
    starts = F.when(before.isNull(), F.col("own")).otherwise(F.col("s") > before)
    rows = written(found.withColumn("starts", starts).withColumn("cluster", F.when(F.col("starts"), F.col("g"))).drop("starts", "own"), "candidates")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return carried(rows, upto, [], ["cluster"]).select("g", "s", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def taken_by_fold(rows: DataFrame) -> DataFrame:
    """g, s of the candidates taken, of clusters that fit an array: each the first to end that begins after the last one taken."""
    line = F.array_sort(F.collect_list(F.struct("g", "s")))
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<g:bigint,s:bigint>>").alias("taken"))
    fold = F.aggregate("line", none, lambda a, c: F.when(c["s"] > a["end"], F.struct(c["g"].alias("end"), F.concat(a["taken"], F.array(c)).alias("taken"))).otherwise(a), lambda a: a["taken"])
    return rows.groupBy("cluster").agg(line.alias("line")).select(F.inline(fold))


def taken_by_pointers(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The same of clusters of any length. Each candidate points to the first that begins after its end; the first of each cluster is taken, and pointers are doubled: what is taken, and what lies one, two, four, ... links from it."""
    ends = rows.select(F.col("g").alias("at"), F.lit(1).alias("kind"), "g")
    both = rows.select(F.col("s").alias("at"), F.lit(0).alias("kind"), "g").unionByName(ends)
    # Candidates are numbered as they begin; as many as began up to an end lie before the one it points to.
    told = running(both, ["at", "kind", "g"], sums={"n": (F.col("kind") == 0).cast("long")}, parts=parts)
    nodes = written(told.groupBy("g").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("c"), (F.max(F.when(F.col("kind") == 1, F.col("n"))) + 1).alias("to")).join(rows, "g"), "nodes")
    first = nodes.groupBy("cluster").agg(F.min("c").alias("c")).select("c")
    taken = written(first, "taken")
    links = written(nodes.select("c", "to").join(first.withColumnRenamed("c", "to"), "to", "left_anti").join(nodes.select(F.col("c").alias("to")), "to", "left_semi").select("c", "to"), "links")
    while links.limit(1).count():
        further = taken.join(links, "c").select(F.col("to").alias("c"))
        taken = written(taken.union(further).distinct(), "taken")
        on = links.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
        links = written(links.join(on, "to").select("c", F.col("beyond").alias("to")), "links")
    return nodes.join(taken, "c", "left_semi").select("g", "s")


def minimal_runs(tx: DataFrame, t: Thresholds = DEFAULT, parts: int | None = None) -> DataFrame:
    """Runs without overlap, each the first to end: from where it ends, the shortest stretch back that reaches the threshold. A null officer is a group of its own. Amounts are summed as whole cents, so a run exactly at the threshold counts; what is not above a cent is no part.

    Nothing holds a vendor's rows together: sums run over the whole table in ranges (parts of them), stretches are found in a range or across its edge, and of overlapping candidates those taken follow from short arrays or doubled pointers.
    """
    limit = round(t.approval * 100)
    rows = numbered(tx, limit, t.split_days, parts)
    inside = rows.where("s is not null").select(PART, "g", "s", F.lit(True).alias("own"))
    found = clustered(inside.unionByName(across(rows, limit, t.split_days, parts).withColumn("own", F.lit(False))))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    long_ones = written(sizes.where(F.col("n") > FOLDED).select("cluster"), "long")
    if long_ones.limit(1).count():
        taken = taken_by_fold(found.join(long_ones, "cluster", "left_anti")).unionByName(taken_by_pointers(found.join(long_ones, "cluster", "left_semi"), parts))
    else:
        taken = taken_by_fold(found)
    each = taken.select(F.col("g").alias("run"), F.explode(F.sequence("s", "g")).alias("g")).join(rows.select("g", "vendor_key", "officer_id", "txn_date", "row_id", "cents"), "g")
    out = each.groupBy("run").agg(
        F.first("vendor_key").alias("vendor_key"), F.first("officer_id").alias("officer_id"), F.transform(F.array_sort(F.collect_list(F.struct("g", "row_id"))), lambda x: x["row_id"]).alias("row_ids"),
        (F.sum("cents") / 100).alias("total"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), F.count("*").cast("int").alias("n_parts"),
    )
    out = written(out.drop("run"), "runs")
    discard(rows)
    return out


def scored_runs(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Runs with the four components of their score."""
    runs = minimal_runs(tx, t).withColumn("run_id", F.element_at("row_ids", 1))
    each = runs.select("run_id", F.explode("row_ids").alias("row_id")).join(tx.select("row_id", F.coalesce("item_category", "item_desc").alias("item"), F.round("unit_price", 2).cast("string").alias("rate")), "row_id")
    told = each.select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("item", "rate")])).alias("x")).select("run_id", "x.*").where("value is not null")
    most = told.groupBy("run_id", "what", "value").agg(F.count("*").alias("n")).groupBy("run_id").agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(f"top_{c}") for c in ("item", "rate")])
    runs = runs.join(most, "run_id", "left")
    windows = [*t.scrutiny_days, t.split_days]
    span, tight = F.datediff("last_date", "first_date"), F.lit(0.5)
    for i in reversed(range(len(windows))):
        tight = F.when(span <= windows[i], 1 - 0.5 * i / max(len(windows) - 1, 1)).otherwise(tight)
    share = lambda c: F.round(F.coalesce(F.col(f"top_{c}") / F.col("n_parts"), F.lit(0.5)), 3)
    tightest = F.lit(windows[-1])
    for w in reversed(windows):
        tightest = F.when(span <= w, w).otherwise(tightest)
    parts = F.when(F.col("n_parts").between(3, 6), 1.0).when(F.col("n_parts") == 2, 0.6).otherwise(0.7)
    # Exact, so that a score on the edge between two is the same whatever the order of its parts.
    total = sum((F.lit(str(w)).cast("decimal(4,2)") * F.col(c).cast("decimal(6,3)") for c, w in WEIGHTS.items()), F.lit(0).cast("decimal(1,0)"))
    return runs.withColumns({"window_days": tightest, "span_days": span, "window": F.round(tight, 3), "homogeneity": share("item"), "single_rate": share("rate"), "parts": parts}).withColumn("score", F.round(total, 4).cast("double")).drop("top_item", "top_rate")


def detect(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Cases of the runs that score enough. A run within the shorter windows breaks a second clause; grain says what the run is of, which a dataset without officers changes."""
    known = tx.where(F.col("amount") < t.approval).agg((F.count("officer_id") > 0).alias("has_officers"))
    runs = scored_runs(tx, t).where(F.col("score") >= t.split_score).crossJoin(F.broadcast(known))  # one row
    grain = F.when(~F.col("has_officers"), "supplier only - dataset has no officer field").when(F.col("officer_id").isNull(), "supplier, officer not recorded").otherwise("supplier and officer")
    clauses = F.when(F.col("window_days") <= max(t.scrutiny_days), ",".join(POLICY_CLAUSES)).otherwise(POLICY_CLAUSES[0])
    more = {"policy_clauses": clauses, "grain": grain, "officer_id": F.col("officer_id"), "parts": F.col("n_parts"), "total": F.round("total", 2), "window_days": F.col("window_days"), "span_days": F.col("span_days"), "homogeneity": F.col("homogeneity"), "single_rate": F.col("single_rate")}
    return cases.build(runs.withColumn("at_risk", F.col("total")), "d2", "split", t, more)
