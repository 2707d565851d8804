"""Samples for people to judge, their sheets, and what their judgements say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.stats import first_digit, wilson
from .vendors import period_end

# The words of a review sheet, and its columns.
VERDICTS = ("plausible", "implausible", "unclear")
COLUMNS = ("case_id", "detector", "anomaly_type", "verdict", "comment")
ROWS_SHOWN = 12
DECISIVE = ("likely_true_positive", "likely_false_positive")
OUTCOMES = (*DECISIVE, "inconclusive", "failed")
PARTS = ("accuracy", "completeness", "clarity", "actionability", "tone")


def sample(cases: DataFrame, per_detector: int, strategy: str = "top", seed: int = 42) -> DataFrame:
    """A fixed sample of each detector's cases: the severest, or spread over all of them by a hash of the case and seed."""
    if strategy not in ("top", "spread"):
        raise ValueError(f"unknown strategy {strategy}")
    order = [F.desc("severity_prelim"), F.asc("case_id")] if strategy == "top" else [F.xxhash64("case_id", F.lit(seed)).asc(), F.asc("case_id")]
    w = Window.partitionBy("detector").orderBy(*order)
    return cases.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_detector).drop("_rank")


def spread_over(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """k rows taken evenly from an order within each group: those at ranks floor(i * n / k). All rows where there are no more than k."""
    w = Window.partitionBy(by)
    r = rows.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy(*order)) - 1})
    # Rank r is taken if some i has floor(i n / k) = r, that is, if ceil(r k / n) < ceil((r + 1) k / n).
    ceil = lambda x: F.floor((x * k + F.col("_n") - 1) / F.col("_n"))
    return r.where((F.col("_n") <= k) | (ceil(F.col("_at")) < ceil(F.col("_at") + 1))).drop("_n", "_at")


def numbered(cases: DataFrame, order: list) -> DataFrame:
    """Cases with the number that a sheet shows, from 1. A sheet is a bounded sample."""
    return cases.withColumn("number", F.row_number().over(Window.orderBy(*order)))


def sheet(chosen: DataFrame) -> DataFrame:
    """A blank sheet: a row a case, by detector and case, with empty columns to fill."""
    return chosen.select("case_id", "detector", "anomaly_type", F.lit("").alias("verdict"), F.lit("").alias("comment")).orderBy("detector", "case_id")


def checked_sheet(filled: DataFrame, chosen: DataFrame) -> DataFrame:
    """line, case_id, verdict, comment, problem of each row that was filled: a case that is not in the sample and a word that is no verdict are problems; rows left blank are not reviewed yet. filled: line and the sheet's columns."""
    if lost := [c for c in ("case_id", "verdict") if c not in filled.columns]:
        raise ValueError(f"the sheet has no column {', '.join(lost)}")
    rows = filled.select("line", F.trim("case_id").alias("case_id"), F.lower(F.trim("verdict")).alias("verdict"), F.nullif(F.trim("comment"), F.lit("")).alias("comment")).where("coalesce(case_id, '') <> '' and coalesce(verdict, '') <> ''")
    known = chosen.select("case_id").distinct().withColumn("_in", F.lit(True))
    wrong = F.when(F.col("_in").isNull(), "not in this batch").when(~F.col("verdict").isin(*VERDICTS), "no verdict")
    return rows.join(known, "case_id", "left").withColumn("problem", wrong).drop("_in")


def import_sheet(old: DataFrame, filled: DataFrame, chosen: DataFrame, reviewer: str, batch: str) -> DataFrame:
    """All reviews after a sheet came in: it replaces what this reviewer said of this batch before. A sheet with a problem is refused whole, with its lines named."""
    rows = checked_sheet(filled, chosen)
    bad = rows.where("problem is not null").orderBy("line").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"line {r.line}: {r.case_id[:8]} {r.problem}" for r in bad))
    if rows.isEmpty():
        raise ValueError("no row is filled yet")
    mine = rows.select("case_id", F.lit(reviewer).alias("reviewer"), F.lit(batch).alias("batch"), "verdict", "comment")
    return old.where(~((F.col("reviewer") == reviewer) & (F.col("batch") == batch))).unionByName(mine)


def cell(c: Column, limit: int = 60) -> Column:
    """Text for a table's cell: blanks are one space, no bar, and short."""
    text = F.replace(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("/"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def majority(reviews: DataFrame) -> DataFrame:
    """case_id, verdict, n, disagreed: the commonest verdict of each case; a tie is 'unclear'."""
    n = reviews.groupBy("case_id", "verdict").agg(F.count("*").alias("n"))
    top = n.withColumns({"_most": F.max("n").over(Window.partitionBy("case_id")), "_kinds": F.count("*").over(Window.partitionBy("case_id")), "_all": F.sum("n").over(Window.partitionBy("case_id"))}).where("n = _most")
    return top.groupBy("case_id").agg(F.when(F.count("*") > 1, "unclear").otherwise(F.min("verdict")).alias("verdict"), F.max("_all").alias("n"), (F.max("_kinds") > 1).alias("disagreed"))


def precision(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each detector with reviewed cases: flagged, reviewed, verdicts, and the share of plausible among those judged, with its interval. Reviews of cases that are gone don't count."""
    of = majority(reviews).join(cases.select("case_id", "detector"), "case_id")
    tally = of.groupBy("detector").agg(F.count("*").alias("reviewed"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    x = tally.join(cases.groupBy("detector").agg(F.count("*").alias("flagged")), "detector")
    judged = F.col("plausible") + F.col("implausible")
    low, high = wilson(F.col("plausible"), judged)
    return x.withColumns({"adjusted_precision": F.col("plausible") / F.nullif(judged, F.lit(0)), "low": low, "high": high})


def disagreements(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that reviewers see differently, with each one's verdict."""
    apart = majority(reviews).where("disagreed").select("case_id")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reviewer", "verdict"))), lambda x: F.concat_ws("=", x["reviewer"], x["verdict"])), ";")
    return reviews.join(apart, "case_id").groupBy("case_id").agg(said.alias("verdicts")).join(cases.select("case_id", "detector"), "case_id")


def triage(items: DataFrame) -> DataFrame:
    """Confusion counts and rates of verdicts on real and spurious cases, by anomaly type and for all. items: anomaly_type, is_real, verdict (null: no note). Rates without anything to measure are null."""
    rows = items.withColumns({"verdict": F.coalesce("verdict", F.lit("failed")), "anomaly_type": F.explode(F.array("anomaly_type", F.lit("all")))})
    count = lambda real, *v: F.count_if((F.col("is_real") == real) & F.col("verdict").isin(*v))
    tally = [count(real, v).alias(f"{name}_{v}") for real, name in ((True, "real"), (False, "spurious")) for v in OUTCOMES]
    x = rows.groupBy("anomaly_type").agg(F.count("*").alias("cases"), F.count_if("is_real").alias("real"), F.count_if(~F.col("is_real")).alias("spurious"), *tally)
    c = lambda *names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    decisive = c(*[f"{name}_{v}" for name in ("real", "spurious") for v in DECISIVE])
    return x.withColumns({
        "real_kept": rate(c("real_likely_true_positive"), c("real")), "real_wrongly_dismissed": rate(c("real_likely_false_positive"), c("real")), "spurious_filtered": rate(c("spurious_likely_false_positive"), c("spurious")),
        "inconclusive": rate(c("real_inconclusive", "spurious_inconclusive"), c("cases")), "failed": rate(c("real_failed", "spurious_failed"), c("cases")),
        "decisive_accuracy": rate(c("real_likely_true_positive", "spurious_likely_false_positive"), decisive),
    })


def trace_stats(traces: DataFrame) -> DataFrame:
    """Tool calls, tokens and seconds of each note's trace."""
    return traces.where("note_id is not null").groupBy("note_id").agg(F.count_if(F.col("kind") == "tool").alias("tools"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("latency_ms").alias("latency_ms"))


def agent_metrics(notes: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: notes, share of citations that pass (weighted by how many a note has), means of their traces, notes tried again and notes that failed. notes: the standing ones."""
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    checked, judged = F.col("citations_checked") > 0, (F.col("citations_checked") > 0) & F.col("semantic_passed").isNotNull()
    x = notes.join(trace_stats(traces), "note_id", "left")
    traced = F.count("tools")
    total = lambda c, when: F.sum(F.when(when, F.coalesce(c, F.lit(0))))
    return x.agg(
        F.count("*").alias("notes"), rate(total(F.col("deterministic_passed"), checked), total(F.col("citations_checked"), checked)).alias("validity_deterministic"),
        rate(total(F.col("semantic_passed"), judged), total(F.col("citations_checked"), judged)).alias("validity_semantic"), rate(F.sum("tools"), traced).alias("avg_tool_calls"), rate(F.sum("tokens"), traced).alias("avg_tokens"),
        rate(F.sum("latency_ms") / 1000, traced).alias("avg_seconds"), F.count_if(F.col("retry_count") > 0).alias("regenerated"), F.count_if(F.col("verification_status") == "failed_after_retries").alias("failed"),
    )


def rubric(grades: DataFrame, notes: DataFrame, cases: DataFrame) -> DataFrame:
    """Mean score of each arm and rubric part, over grades of notes that still exist; total counts only grades with every part scored. grades: note_id, grader and the parts."""
    x = grades.join(notes.select("note_id", "case_id", F.coalesce("arm", F.lit("full")).alias("arm")), "note_id").join(cases.select("case_id", "anomaly_type"), "case_id", "left")
    whole = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("score")) for p in PARTS], F.struct(F.lit("total").alias("part"), whole.cast("double").alias("score"))))
    return x.select("arm", each.alias("g")).where("g.score is not null").groupBy("arm", "g.part").agg(F.count("*").alias("n"), F.avg("g.score").alias("mean"))


def evidence_rows(cases: DataFrame, tx: DataFrame, t: Thresholds = DEFAULT, budget: int = ROWS_SHOWN) -> DataFrame:
    """case_id, at, row_id, why: the rows of vendor flags that a reviewer is shown, taken in turn from a list for each reason, largest amounts first, none twice.

    cases: case_id, row_ids, new_vendor_high_value, first_seen, indicators (comma list), digit (the over-represented one, or null). Of each list only its first budget * (number of lists) rows can matter, so what is folded for a case is bounded.
    """
    reasons = ("new vendor", "period end", "round number", "leading digit", "largest")
    rows = cases.withColumn("row_id", F.explode("row_ids")).drop("row_ids").join(tx.select("row_id", "amount", "txn_date"), "row_id")
    has = lambda name: F.array_contains(F.split(F.coalesce("indicators", F.lit("")), ","), name)
    fits = (
        F.col("new_vendor_high_value") & F.datediff("txn_date", "first_seen").between(0, t.new_vendor_days), has("period_end") & period_end(F.col("txn_date")), has("round_numbers") & (F.col("amount") % t.round_unit == 0),
        has("first_digit") & F.when(F.col("amount") > 0, first_digit(F.col("amount")) == F.col("digit")), F.lit(True),
    )
    listed = rows.withColumn("reason", F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(fits)]), lambda x: x.isNotNull())))
    w = Window.partitionBy("case_id", "reason").orderBy(F.desc("amount"), "row_id")
    listed = listed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget * len(reasons))
    lists = listed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("reason", "rank", "row_id"))).alias("lists"))
    picked = "array<struct<row_id:bigint,reason:int>>"

    def turn(state: Column, at: Column) -> Column:
        seen = F.transform(state, lambda x: x["row_id"])
        free = F.filter("lists", lambda x: (x["reason"] == at % len(reasons)) & ~F.array_contains(seen, x["row_id"]))
        take = F.array(F.struct(F.element_at(free, 1)["row_id"].alias("row_id"), F.element_at(free, 1)["reason"].alias("reason"))).cast(picked)
        return F.when((F.size(state) < budget) & (F.size(free) > 0), F.concat(state, take)).otherwise(state)

    turns = F.sequence(F.lit(0), F.lit(budget * len(reasons) - 1))
    out = lists.select("case_id", F.posexplode(F.aggregate(turns, F.array().cast(picked), turn)).alias("at", "x"))
    return out.select("case_id", (F.col("at") + 1).alias("at"), "x.row_id", F.element_at(F.array(*[F.lit(r) for r in reasons]), F.col("x.reason") + 1).alias("why"))
