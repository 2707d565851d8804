"""Checks of what notes on cases say: cited rows, stated values, clauses, wording."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import indian_money, same_number, same_text, stated_date

NUMBERS = ("amount", "quantity", "unit_price")
DATES = ("txn_date",)
# The clauses that each kind of case rests on.
CLAUSES = {"duplicate": ("SG-PP-4.4", "SG-PP-4.1"), "split": ("SG-PP-3.1", "SG-PP-3.2"), "inflation": ("SG-PP-6.3", "SG-PP-6.2"), "vendor_flag": ("SG-PP-5.5", "SG-PP-5.3")}
#: What a template note says of each kind of case; {supplier}, {when}, {money} and {n} stand for its own.
TEXTS = {
    "duplicate": "Records of {supplier} {when} repeat one another ({n} in all). What goes beyond the first is {money}.",
    "split": "Purchases from {supplier} {when}, each below the approval limit, make {money} together ({n} in all).",
    "inflation": "{supplier} billed {when} above what its category usually costs: {money} more than expected ({n} in all).",
    "vendor_flag": "What {supplier} billed {when} is unlike its peers' billing: {money} in {n} records.",
}


def says_paid_twice(text: Column) -> Column:
    """Whether a note speaks of duplicate payments, which records of purchases cannot show. The register of that name may be cited."""
    plain = F.regexp_replace(F.lower(text), "[ \t\n-]+", " ")
    return F.regexp_replace(plain, "duplicate payments? register", "").contains("duplicate payment")


def value_matches(field: Column, stated: Column, row: dict[str, Column]) -> Column:
    """Whether what a note states of a field is what the row holds. A null in the row is met by null or a word for it."""
    actual = F.coalesce(*[F.when(field == k, c.cast("string")) for k, c in row.items()])
    nothing = stated.isNull() | F.regexp_replace(F.lower(stated), r"""^[ .'"]+|[ .'"]+$""", "").isin("", "null", "none")
    number = F.coalesce(F.lit(None).cast("boolean"), *[F.when(field == k, same_number(stated, row[k])) for k in NUMBERS if k in row])
    date = F.coalesce(F.lit(None).cast("boolean"), *[F.when(field == k, F.coalesce(stated_date(stated) == row[k], F.lit(False))) for k in DATES if k in row])
    return F.when(actual.isNull(), nothing).when(stated.isNull(), F.lit(False)).otherwise(F.coalesce(number, date, same_text(stated, actual)))


def check_citations(citations: DataFrame, tx: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """note_id, claim_index, row_id, field, row_exists, value_ok, problem for each stated fact. A fact on a row that is not there fails."""
    known = tx.select("row_id", F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    x = citations.join(known, "row_id", "left").withColumn("row_exists", F.col("_there").isNotNull())
    ok = F.col("row_exists") & value_matches(F.col("field"), F.col("stated"), {f: F.col(f"_{f}") for f in fields})
    problem = F.when(~F.col("row_exists"), F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(" does not exist"))).when(~F.col("value_ok"), F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(" "), F.col("field"), F.lit(" differs")))
    return x.withColumn("value_ok", ok).withColumn("problem", problem).select("note_id", "claim_index", "row_id", "field", "row_exists", "value_ok", "problem")


def note_checks(notes: DataFrame, clauses: DataFrame) -> DataFrame:
    """note_id, problem: clauses that the policy hasn't, and wording that is not allowed. notes: note_id, text, clauses (array)."""
    cited = notes.select("note_id", F.explode(F.array_distinct("clauses")).alias("clause_id")).join(clauses.select("clause_id").distinct(), "clause_id", "left_anti")
    unknown = cited.select("note_id", F.concat(F.lit("no clause "), "clause_id").alias("problem"))
    return unknown.unionByName(notes.where(says_paid_twice(F.col("text"))).select("note_id", F.lit("wording").alias("problem")))


def report(notes: DataFrame, checked: DataFrame, problems: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Each note's counts and release status: 'failed_after_retries' if anything is known to be wrong, 'verified' if nothing is and the judge answered for it, else 'unverified'. judged: note_id, claim_index, supports."""
    by = checked.groupBy("note_id").agg(F.count("*").alias("checked"), F.count_if("value_ok").alias("passed"))
    wrong = problems.groupBy("note_id").agg(F.count("*").alias("note_problems"))
    x = notes.select("note_id").join(by, "note_id", "left").join(wrong, "note_id", "left").fillna(0, ["checked", "passed", "note_problems"])
    if judged is None:
        x = x.withColumns({"judge_ran": F.lit(False), "unsupported": F.lit(0).cast("long")})
    else:
        said = judged.groupBy("note_id").agg(F.count("*").alias("_n"), F.count_if(~F.col("supports")).alias("unsupported"))
        x = x.join(said, "note_id", "left").withColumn("judge_ran", F.col("_n").isNotNull()).drop("_n").fillna(0, ["unsupported"])
    failures = F.col("checked") - F.col("passed") + F.col("note_problems") + F.col("unsupported")
    status = F.when(failures > 0, "failed_after_retries").when(F.col("judge_ran"), "verified").otherwise("unverified")
    return x.withColumns({"failures": failures, "verification_status": status})


def template_notes(cases: DataFrame, tx: DataFrame) -> DataFrame:
    """case_id, finding, clauses, facts (row_id, field, value): a note that restates what a detector found and interprets nothing. Values are the rows' own, so every fact passes the checks."""
    rows = cases.select("case_id", F.explode("row_ids").alias("row_id")).join(tx.select("row_id", "vendor_name", "amount", "txn_date"), "row_id")
    fact = F.struct("row_id", F.lit("amount").alias("field"), F.col("amount").cast("string").alias("value"))
    seen = rows.groupBy("case_id").agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last"), F.min_by("vendor_name", "row_id").alias("supplier"), F.array_sort(F.collect_list(fact)).alias("facts"))
    x = cases.join(seen, "case_id")
    n = F.size("row_ids")
    of = lambda table: F.coalesce(*[F.when(F.col("anomaly_type") == k, v) for k, v in table.items()])
    when = F.when(F.col("first") == F.col("last"), F.concat(F.lit("on "), F.col("first").cast("string"))).otherwise(F.concat(F.lit("from "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string")))
    own = {"supplier": F.col("supplier"), "when": when, "money": indian_money(F.col("amount_at_risk")), "n": n.cast("string")}

    def filled(text: str) -> Column:
        pieces = [own[p[1:-1]] if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p]
        return F.concat(*pieces, F.lit(" Found by "), F.upper("detector"), F.lit(" with a score of "), F.format_string("%.2f", "detector_score"), F.lit("."))

    finding = of({k: filled(v) for k, v in TEXTS.items()})
    return x.select("case_id", finding.alias("finding"), of({k: F.array(*[F.lit(c) for c in v]) for k, v in CLAUSES.items()}).alias("clauses"), "facts")


#: Characters of a result that are kept.
KEPT_CHARS = 20_000


def kept_result(value: Column, most: int = KEPT_CHARS) -> Column:
    """A result as JSON text, as it is up to so many characters; a longer one by its beginning, and with how long it was, so that nothing is cut unseen."""
    return F.when(value.isNull() | (F.length(value) <= most), value).otherwise(F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(value).alias("chars"), F.substring(value, 1, most).alias("head"))))


def citation_rows(notes: DataFrame, checked: DataFrame) -> DataFrame:
    """A row for each claim of a note and each row that it cites: note_id, claim_index, claim, row_id, asserted (what it states, JSON), row_exists, values_match, failure. What was not checked has nulls there. notes: note_id, claims (an array of text, cited: an array of row_id, field, stated); checked: as check_citations gives it."""
    claims = notes.select("note_id", F.posexplode("claims").alias("claim_index", "claim"))
    each = claims.select("note_id", "claim_index", F.col("claim.text").alias("claim"), F.explode("claim.cited").alias("c")).select("note_id", "claim_index", "claim", "c.*")
    stated = F.to_json(F.array_sort(F.collect_set(F.struct("field", "stated"))))
    said = each.groupBy("note_id", "claim_index", "claim", "row_id").agg(stated.alias("asserted"))
    found = checked.groupBy("note_id", "claim_index", "row_id").agg(F.bool_and("row_exists").alias("row_exists"), F.bool_and("value_ok").alias("values_match"), F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("failure"))
    out = said.join(found, ["note_id", "claim_index", "row_id"], "left")
    return out.select("note_id", "claim_index", "claim", "row_id", kept_result(F.col("asserted")).alias("asserted"), "row_exists", "values_match", F.nullif("failure", F.lit("")).alias("failure"))


def trace_rows(traces: DataFrame) -> DataFrame:
    """Steps of investigations as they are kept: what a tool was asked and answered no longer than KEPT_CHARS."""
    return traces.withColumns({c: kept_result(F.col(c)) for c in ("tool_args", "tool_result")})
