"""Queries an auditor asks of vendors and transactions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import BENFORD, first_digit
from ..sources.scratch import discard, written
from .baseline import money
from .ranks import running


def vendor_profiles(tx: DataFrame) -> DataFrame:
    return tx.groupBy("vendor_key").agg(
        F.count("*").alias("n"), money("amount").alias("total"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), F.countDistinct("amount").alias("n_amounts"), F.countDistinct("officer_id").alias("n_officers"), F.count_if(F.col("amount") % 1000 == 0).alias("n_round")
    )


def top_totals(tx: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k largest totals by a column within each vendor."""
    sums = tx.groupBy("vendor_key", by).agg(F.count("*").alias("n"), money("amount").alias("total"))
    w = Window.partitionBy("vendor_key").orderBy(F.desc("total"), F.col(by).asc_nulls_last())
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recurring_billing(tx: DataFrame, months: int = 6) -> DataFrame:
    found = tx.groupBy("vendor_key", "amount").agg(F.countDistinct(F.trunc("txn_date", "MM")).alias("n_months"), F.count("*").alias("n"))
    return found.where(F.col("n_months") >= months)


def recurring_top(tx: DataFrame, months: int = 6, k: int = 3) -> DataFrame:
    """Each vendor's k amounts that recur in most months, ties by amount: billing that looks like a fixed contract."""
    w = Window.partitionBy("vendor_key").orderBy(F.desc("n_months"), "amount")
    return recurring_billing(tx, months).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recent(tx: DataFrame, months: int) -> DataFrame:
    """Rows of the last months up to the newest date."""
    last = tx.agg(F.add_months(F.max("txn_date"), -months).alias("_from"))
    return tx.crossJoin(F.broadcast(last)).where("txn_date > _from").drop("_from")  # one row


def by_ids(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with the ids."""
    return tx.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def benford_vendor(tx: DataFrame, vendor: str, least: int = 30) -> DataFrame:
    """digit, observed, peers, benford: shares of first digits over a vendor's distinct amounts, over those of all rows in its categories, and as Benford has them; no rows where the vendor has too few amounts. Peers are what counts: invoices are quantities times prices and depart from Benford as a rule."""
    own = tx.where((F.col("vendor_key") == vendor) & (F.col("amount") > 0))
    peers = tx.where("amount > 0").join(F.broadcast(own.where("item_category is not null").select("item_category").distinct()), "item_category", "left_semi")  # one vendor's categories
    shares = None
    for name, rows in (("observed", own), ("peers", peers)):
        n = rows.select("amount").distinct().groupBy(first_digit(F.col("amount")).alias("digit")).agg(F.count("*").alias("n"))
        x = n.select("digit", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name), F.sum("n").over(Window.partitionBy()).alias(f"n_{name}"))  # nine rows
        shares = x if shares is None else shares.join(x, "digit", "full")
    digits = tx.sparkSession.createDataFrame([(d, BENFORD[d - 1]) for d in range(1, 10)], "digit int, benford double")
    out = digits.join(shares, "digit", "left").fillna(0.0, ["observed", "peers"])
    return out.withColumn("n", F.max("n_observed").over(Window.partitionBy())).where(F.col("n") >= least).select("digit", "observed", "peers", "benford")


#: Values that a task looks at together, of one group or of several.
STRETCH = 4096


def nearest(rows: DataFrame, by: str, value: str, k: int, most: float | None = None, stretch: int = STRETCH) -> DataFrame:
    """row_id, rank, near_id, gap: for each row the k other rows of its group closest in value, ties by row_id, at most most away. Rows without a value are looked up as 0 and found by none; rows without a group have no others.

    Of equal values only the k + 1 least ids can be among the closest, so a value that many rows share is one line. Lines are numbered in one order of groups and values and dealt to stretches of that many, each with the k + 1 lines beyond either end: neither a group nor a value is gathered. Rows of one value share its answer, but for themselves.
    """
    rows = written(rows.select("row_id", F.col(by).alias("of"), F.col(value).cast("double").alias("v")).where("of is not null"), "valued")
    reach = k + 1
    least = Window.partitionBy("of", "v").orderBy("row_id")
    ids = rows.where("v is not null").withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= reach).select("of", "v", F.array("row_id").alias("ids"))
    asked = rows.where("v is null").select("of", F.lit(0.0).alias("v"), F.array().cast("array<bigint>").alias("ids")).distinct()
    lines = ids.unionByName(asked).groupBy("of", "v").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))  # k + 1 of them
    lines = running(lines, ["of", "v"], rank="g")
    at, own = F.col("g") % stretch, F.floor(F.col("g") / stretch)
    dealt = lines.withColumn("own", own).withColumn("stretch", F.explode(F.filter(F.array(F.col("own"), F.when(at <= reach, F.col("own") - 1), F.when(at >= stretch - 1 - reach, F.col("own") + 1)), lambda x: x.isNotNull())))
    # A line that was only asked for holds no id, so it does not count as one of the k.
    beside = Window.partitionBy("stretch").orderBy("g").rowsBetween(-reach, reach)
    around = dealt.withColumn("around", F.collect_list(F.struct("of", "v", "ids")).over(beside)).where("own = stretch")
    found = F.flatten(F.transform(F.filter("around", lambda x: x["of"] == F.col("of")), lambda x: F.transform(x["ids"], lambda i: F.struct(F.abs(x["v"] - F.col("v")).alias("gap"), i.alias("near_id")))))
    found = found if most is None else F.filter(found, lambda x: x["gap"] <= most)
    answers = around.select("of", "v", F.slice(F.array_sort(found), 1, k + 1).alias("found"))
    both = rows.withColumn("v", F.coalesce("v", F.lit(0.0))).join(answers, ["of", "v"])
    others = F.slice(F.filter("found", lambda x: x["near_id"] != F.col("row_id")), 1, k)
    return both.select("row_id", F.posexplode(others).alias("at", "x")).select("row_id", (F.col("at") + 1).alias("rank"), "x.near_id", "x.gap")


def same_supplier(tx: DataFrame, k: int = 5, days: int = 90) -> DataFrame:
    """For each row the k rows of its vendor nearest in time, at most days away, ties by row_id."""
    return nearest(tx.select("row_id", "vendor_key", F.unix_date("txn_date").alias("day")).where("day is not null"), "vendor_key", "day", k, days)


def same_commodity(tx: DataFrame, k: int = 5) -> DataFrame:
    """For each row with a category the k other rows of it closest in unit price, ties by row_id. Rows without a price are looked up as 0 and found by none."""
    return nearest(tx.select("row_id", "item_category", "unit_price"), "item_category", "unit_price", k)


def similar_rows(tx: DataFrame, k: int = 5, days: int = 90) -> DataFrame:
    """Both lists of every row: leg, row_id, rank, near_id, gap (days or money)."""
    tx = written(tx.select("row_id", "vendor_key", "item_category", "txn_date", "unit_price"), "looked-up")
    legs = {"same_supplier": same_supplier(tx, k, days), "same_commodity": same_commodity(tx, k)}
    discard(tx)  # each leg has stored what it needs of it
    out = [df.withColumn("leg", F.lit(name)) for name, df in legs.items()]
    return out[0].unionByName(out[1])


def search(tx: DataFrame, words: str | None = None, vendor: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows that hold the words in any text column and fit the bounds."""
    if words:
        hit = F.lit(False)
        for c in ("vendor_name", "invoice_no", "officer_id", "item_desc", "item_category"):
            hit = hit | F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
        tx = tx.where(hit)
    for c in [F.col("vendor_key") == vendor] * (vendor is not None) + [F.col("amount") >= least] * (least is not None) + [F.col("amount") <= most] * (most is not None):
        tx = tx.where(c)
    return tx


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def totals(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("n"), money("amount").alias("total"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), F.countDistinct("vendor_key").alias("n_vendors"))


def benford(tx: DataFrame) -> DataFrame:
    """Observed and expected share of each first digit over distinct amounts."""
    digits = tx.where("amount > 0").select("amount").distinct().groupBy(first_digit(F.col("amount")).alias("digit")).agg(F.count("*").alias("n"))
    expected = F.element_at(F.array(*[F.lit(x) for x in BENFORD]), F.col("digit"))
    return digits.select("digit", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.round(expected, 9).alias("expected"))


# Words that a read-only query may not hold.
FORBIDDEN = (
    "insert", "update", "delete", "drop", "create", "alter", "truncate", "replace",
    "attach", "detach", "copy", "export", "import", "install", "load", "pragma",
    "call", "set", "begin", "commit", "rollback", "grant", "revoke",
)
#: Nodes of a parsed plan that only read what is below them.
READS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedHaving Join LateralJoin Distinct Union Except Intersect Window WithWindowDefinition "
    "OneRowRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases Generate Pivot Unpivot Expand".split()
)
#: Functions that reach outside the query.
REACHING = re.compile(r"(?i)\b(?:reflect|java_method|try_reflect|input_file_name)\s*\(")


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_relations(plan, own: frozenset[str], view: str) -> None:
    """Raises unless the parsed plan reads the view and its own named subqueries alone, each within its scope."""
    kind = plan.nodeName()
    if kind == "UnresolvedRelation":
        name = [x.lower() for x in _scala(plan.multipartIdentifier())]
        if len(name) > 1 or (name[0] not in own and name[0] != view):
            raise ValueError(f"not readable: {'.'.join(name)}")
        return
    if kind == "UnresolvedWith":
        for cte in _scala(plan.cteRelations()):
            _check_relations(cte._2().child(), own, view)
            own = own | {cte._1().lower()}
        _check_relations(plan.child(), own, view)
        return
    if kind not in READS:
        raise ValueError(f"{kind} is not allowed")
    for below in [*_scala(plan.children()), *_scala(plan.subqueries())]:
        _check_relations(below, own, view)


def checked_sql(spark: SparkSession, sql: str, view: str = "audit_transactions") -> str:
    """The statement, if it is one read of the audit view. Names come from Spark's parsed plan, so string literals, quoting and scopes are as Spark takes them."""
    text = sql.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("one SELECT is allowed")
    if bad := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", text) or REACHING.search(text):
        raise ValueError(f"{bad[0]} is not allowed")
    _check_relations(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset(), view.lower())
    return text


def guarded(spark: SparkSession, sql: str, view: str = "audit_transactions", rows: int = 50) -> DataFrame:
    """The first rows of a single read-only query over the audit view and its own CTEs; one more than rows tells that there are more."""
    return spark.sql(checked_sql(spark, sql, view)).limit(rows + 1)
