"""The queue of cases: what detectors found, what people and models made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .cases import band
from .store import latest

# Which status may follow which, and the names that detectors go by.
TRANSITIONS = {
    "new": ("new", "under_review", "confirmed", "dismissed"),
    "under_review": ("under_review", "confirmed", "dismissed"),
    "confirmed": ("confirmed", "under_review"),
    "dismissed": ("dismissed", "under_review"),
}
KINDS = {"duplicate": ("duplicates", "d1", "d1_duplicate", "d1_duplicates"), "split": ("splits", "d2", "d2_split", "d2_splits"), "inflation": ("d3", "d3_inflation"), "vendor_flag": ("vendor", "vendor_risk", "d4", "d4_vendor", "d4_vendor_risk")}
ALIASES = {a: k for k, names in KINDS.items() for a in (k, *names)}
OPEN = ("new", "under_review")
EXCERPT = 180


def latest_notes(notes: DataFrame, model: str | None = None, arm: str | None = None) -> DataFrame:
    """The note that stands for each case: the newest that is no ablation's, of one model or arm where named. Equal times are settled by note_id."""
    rows = notes.where(F.col("arm") == arm) if arm else notes.where(~F.col("is_ablation"))
    rows = rows.where(F.col("model") == model) if model else rows
    return latest(rows, ["case_id"], [F.desc("created_at"), F.asc("note_id")])


def with_notes(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Cases with the verdict and state of their standing note, null where they have none."""
    kept = latest_notes(notes).select("case_id", "note_id", "verdict", "verification_status", "citations_checked", "citations_passed", "finding")
    return cases.join(kept, "case_id", "left")


def excerpt(c: Column, n: int = EXCERPT) -> Column:
    """Text cut to n characters, the last an ellipsis; empty is null."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, n - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(F.length(c) <= n, c).otherwise(cut)


def select(cases: DataFrame, status: list[str] | None = None, kinds: list[str] | None = None, bands: list[str] | None = None, verdicts: list[str] | None = None, verification: list[str] | None = None,
           investigated: bool | None = None, dismissed: bool | None = None, search: str | None = None, least: float | None = None) -> DataFrame:
    """Cases with notes that fit every filter given. kinds may be anomaly types or names of detectors."""
    chosen = [("status", status), ("anomaly_type", [ALIASES.get(k.lower(), k) for k in kinds or []]), ("band", bands), ("verdict", verdicts), ("verification_status", verification)]
    for column, values in chosen:
        if values:
            cases = cases.where(F.col(column).isin(values))
    for column, wanted in (("investigated", investigated), ("dismissed_by_agent", dismissed)):
        if wanted is not None:
            cases = cases.where(F.col(column) == wanted)
    if search and search.strip():
        like = f"%{search.strip()}%"
        cases = cases.where(F.col("vendor_key").ilike(like) | F.col("case_id").ilike(like) | F.col("detector").ilike(like))
    return cases if least is None else cases.where(F.col("amount_at_risk") >= least)


def page(cases: DataFrame, sort: str = "severity_prelim", descending: bool = True, number: int = 1, size: int = 50, most: int = 200) -> DataFrame:
    """One page, nulls last, ties by case_id. Only the rows up to its end are ranked."""
    size = min(size, most)
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return cases.orderBy(order, "case_id").offset((number - 1) * size).limit(size)


def kpis(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """name, value, n, money: counts by type, band, status, verdict and verification, and totals. What a person dismissed is no longer at risk."""
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_at_risk").cast("decimal(18,2)"))), F.lit(0)).cast("double")
    every = with_notes(cases, notes)
    facets = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for name, c in (("type", "anomaly_type"), ("band", "band"), ("status", "status"), ("verdict", "verdict"), ("verification", "verification_status"))])
    by = every.select(F.explode(facets).alias("f"), "amount_at_risk").where("f.value is not null").groupBy("f.name", "f.value").agg(F.count("*").alias("n"), money(F.lit(True)).alias("money"))
    sums = {"flagged": F.lit(True), "investigated": F.col("investigated"), "queued": ~F.col("investigated"), "at_risk": F.col("status") != "dismissed", "confirmed": F.col("status") == "confirmed"}
    row = cases.agg(*[F.struct(F.lit("total").alias("name"), F.lit(k).alias("value"), F.count_if(c).alias("n"), money(c).alias("money")).alias(k) for k, c in sums.items()])
    return by.unionByName(row.select(F.explode(F.array(*sums)).alias("x")).select("x.*"))


def to_investigate(cases: DataFrame, top: int, kind: str | None = None, again: bool = False) -> DataFrame:
    """The open cases of greatest preliminary severity, not those investigated already unless asked."""
    rows = cases.where(F.col("status").isin(*OPEN))
    rows = rows if again else rows.where(~F.col("investigated"))
    rows = rows if kind is None else rows.where(F.col("anomaly_type") == kind)
    return rows.orderBy(F.desc("severity_prelim"), "case_id").limit(top)


def attempts(traces: DataFrame) -> DataFrame:
    """How many runs have tried each case."""
    return traces.groupBy("case_id").agg(F.count_distinct("run_id").alias("attempts"))


def final_severity(prelim: Column, verdict: Column, t: Thresholds = DEFAULT) -> Column:
    """The number after a verdict: below the medium band for a likely false positive, below the high one for an inconclusive, else as it was."""
    capped = F.when(verdict == "likely_false_positive", F.least(prelim, F.lit(t.band_medium - 0.01))).when(verdict == "inconclusive", F.least(prelim, F.lit(t.band_high - 0.01))).otherwise(prelim)
    return F.round(F.greatest(capped, F.lit(0.0)), 2)


def apply_verdicts(cases: DataFrame, notes: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Cases with what their standing notes say: investigated, final severity, its band, whether the model dismissed it. The review status stays, as only people set it."""
    x = with_notes(cases.drop("severity_final", "dismissed_by_agent"), notes)
    final = final_severity(F.col("severity_prelim"), F.col("verdict"), t)
    seen = F.col("verdict").isNotNull()
    return x.withColumns({"severity_final": F.when(seen, final), "band": F.when(seen, band(final, t)).otherwise(F.col("band")), "investigated": F.col("investigated") | seen, "dismissed_by_agent": F.coalesce(F.col("verdict") == "likely_false_positive", F.lit(False))})


def save(old: DataFrame, new: DataFrame, dataset: str, run_id: str, reset: bool = False) -> DataFrame:
    """The store after a run: new cases begin as 'new'; known ones take the detector's figures and keep what people decided, and their band once they were investigated. A store of another dataset is refused unless it is reset.

    old: dataset, status, investigated, reviewer_note beside the case's columns. action tells inserted, refreshed and kept rows.
    """
    figures = ["detector_score", "amount_at_risk", "severity_prelim", "metadata"]
    other = old.where(F.col("dataset") != dataset)
    if not reset and not other.isEmpty():
        raise ValueError(f"the store holds cases of other datasets than {dataset}; reset it or use another")
    o = (old.limit(0) if reset else old).alias("o")
    n = new.alias("n")
    both = o.join(n, "case_id", "full")
    known, fresh = F.col("o.status").isNotNull(), F.col("n.detector").isNotNull()
    take = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return both.select(
        "case_id", F.coalesce("o.dataset", F.lit(dataset)).alias("dataset"), F.when(fresh, F.lit(run_id)).otherwise(F.col("o.run_id")).alias("run_id"), keep("anomaly_type"), keep("detector"), keep("row_ids"), keep("vendor_key"),
        *[take(c) for c in figures], F.when(known & (F.col("o.investigated") | ~fresh), F.col("o.band")).otherwise(F.col("n.band")).alias("band"),
        F.coalesce("o.status", F.lit("new")).alias("status"), F.coalesce("o.investigated", F.lit(False)).alias("investigated"), F.col("o.reviewer_note").alias("reviewer_note"),
        F.when(~known, "inserted").when(fresh, "refreshed").otherwise("kept").alias("action"),
    )


def review(cases: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases after people's changes, and the history of these: case_id, at, previous, status, note, reviewer, allowed.

    changes: case_id, at, change_id, status, note, reviewer. They apply in order of at and change_id, each to the state that the last allowed one left; one that the rules don't allow changes nothing. A blank note clears, a null one keeps. The rules are folded over each case's own few changes.
    """
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    one = F.struct("at", "change_id", "status", F.col("note").alias("said"), F.coalesce(F.nullif(F.trim("reviewer"), F.lit("")), F.lit("Demo Reviewer")).alias("reviewer"))
    listed = changes.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("changes"))
    rows = cases.join(listed, "case_id")
    log = "array<struct<at:timestamp,change_id:bigint,previous:string,status:string,note:string,reviewer:string,allowed:boolean>>"

    def step(state: Column, x: Column) -> Column:
        ok = F.array_contains(F.element_at(allowed, state["status"]), x["status"])
        note = F.when(x["said"].isNull(), state["note"]).otherwise(F.nullif(F.trim(x["said"]), F.lit("")))
        entry = F.struct(x["at"].alias("at"), x["change_id"].alias("change_id"), state["status"].alias("previous"), x["status"].alias("status"), F.when(ok, note).otherwise(state["note"]).alias("note"), x["reviewer"].alias("reviewer"), ok.alias("allowed"))
        return F.struct(F.when(ok, x["status"]).otherwise(state["status"]).alias("status"), F.when(ok, note).otherwise(state["note"]).alias("note"), F.concat(state["log"], F.array(entry)).cast(log).alias("log"))

    start = F.struct(F.col("status").alias("status"), F.col("reviewer_note").cast("string").alias("note"), F.array().cast(log).alias("log"))
    folded = rows.select("case_id", F.aggregate("changes", start, step).alias("end"))
    ends = folded.select("case_id", F.col("end.status").alias("_status"), F.col("end.note").alias("_note"))
    after = cases.join(ends, "case_id", "left").withColumns({"status": F.coalesce("_status", "status"), "reviewer_note": F.when(F.col("_status").isNull(), F.col("reviewer_note")).otherwise(F.col("_note"))}).drop("_status", "_note")
    return after, folded.select("case_id", F.explode("end.log").alias("x")).select("case_id", "x.*")


def evidence(tx: DataFrame, cases: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """The rows of each case, by date and row_id, with whether the case's note cites them (case_id, row_id)."""
    rows = cases.select("case_id", F.explode("row_ids").alias("row_id")).join(tx, "row_id")
    if cited is None:
        return rows.withColumn("cited", F.lit(False))
    marks = cited.select("case_id", "row_id").distinct().withColumn("_c", F.lit(True))
    return rows.join(marks, ["case_id", "row_id"], "left").withColumn("cited", F.coalesce("_c", F.lit(False))).drop("_c")


def nearby(tx: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Of each case's vendor the k rows outside the case nearest in time to the case's first row, ties by row_id."""
    own = cases.select("case_id", "vendor_key", F.explode("row_ids").alias("row_id"))
    around = own.join(tx.select("row_id", "txn_date"), "row_id").groupBy("case_id", "vendor_key").agg(F.min("txn_date").alias("around"))
    others = around.join(tx.select("vendor_key", "row_id", "txn_date"), "vendor_key").join(own.select("case_id", "row_id"), ["case_id", "row_id"], "left_anti")
    gap = F.abs(F.datediff("txn_date", "around"))
    w = Window.partitionBy("case_id").orderBy("days", "row_id")
    return others.select("case_id", "row_id", gap.alias("days")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def history(runs: DataFrame, size: int = 20) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(size)


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of runs by run_id; a new record replaces the old one whole."""
    return new.unionByName(old.join(new.select("run_id"), "run_id", "left_anti"))
