"""Queries of the queue of cases, of reviews and of notes, with the SQL that gives the same rows.

The provided tables stand in for what people and models write: customers are cases, orders are notes on their customer, line items are traces and citations of their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as case_table
from ..operators import notes as note_checks
from ..operators import policy, queue, report, review, store
from ..sources.adapter import TXO_SQL, ascii_key, orders, table

KIND = "CASE WHEN c_nationkey < 6 THEN 'duplicate' WHEN c_nationkey < 12 THEN 'split' WHEN c_nationkey < 18 THEN 'inflation' ELSE 'vendor_flag' END"
DETECTOR = "CASE WHEN c_nationkey < 6 THEN 'd1' WHEN c_nationkey < 12 THEN 'd2' WHEN c_nationkey < 18 THEN 'd3' ELSE 'd4' END"
STATUS = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'under_review' WHEN 'FURNITURE' THEN 'confirmed' WHEN 'HOUSEHOLD' THEN 'dismissed' ELSE 'new' END"
VERDICT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'likely_true_positive' WHEN '2-HIGH' THEN 'likely_false_positive' WHEN '3-MEDIUM' THEN 'inconclusive' END"
SEVERITY = "round(100 * least(ln(1 + greatest(c_acctbal * 100, 0)) / ln(1 + 1e7), 1.0), 2)"
BAND = "CASE WHEN {0} >= 66 THEN 'high' WHEN {0} >= 33 THEN 'medium' ELSE 'low' END"
CASES_SQL = f"""cs AS (SELECT *, {BAND.format('severity_prelim')} AS band FROM (SELECT c_custkey::VARCHAR AS case_id, {KIND} AS anomaly_type, {DETECTOR} AS detector, lower(c_name) AS vendor_key, {STATUS} AS status, c_mktsegment IN ('MACHINERY', 'BUILDING') AS investigated,
  c_nationkey = 3 AS dismissed_by_agent, {SEVERITY} AS severity_prelim, greatest(c_acctbal, 0) AS amount_at_risk FROM customer))"""
NOTES_SQL = f"""no AS (SELECT o_orderkey AS note_id, o_custkey::VARCHAR AS case_id, o_orderdate AS created_at, {VERDICT} AS verdict, o_orderstatus = 'P' AS is_ablation, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'unverified' END AS verification_status,
  (floor(o_totalprice)::BIGINT % 9) AS citations_checked, (floor(o_totalprice)::BIGINT % 9) // 2 AS citations_passed, 'Order of ' || o_orderdate::DATE AS finding FROM orders),
la AS (SELECT * FROM no WHERE NOT is_ablation QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, note_id) = 1)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    x = rows.selectExpr("cast(c_custkey as string) as case_id", f"{KIND} as anomaly_type", f"{DETECTOR} as detector", "lower(c_name) as vendor_key", f"{STATUS} as status", "c_mktsegment in ('MACHINERY', 'BUILDING') as investigated", "c_nationkey = 3 as dismissed_by_agent", "greatest(c_acctbal, 0) as amount_at_risk", "c_acctbal")
    severity = case_table.severity(F.lit(1.0), F.col("c_acctbal") * 100)
    return x.withColumn("severity_prelim", severity).withColumn("band", case_table.band(F.col("severity_prelim"))).drop("c_acctbal")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = "cast(floor(o_totalprice) as bigint) % 9"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as note_id", "cast(o_custkey as string) as case_id", "o_orderdate as created_at", f"{VERDICT} as verdict", "o_orderstatus = 'P' as is_ablation", "case when o_orderstatus = 'F' then 'verified' else 'unverified' end as verification_status",
        f"{checked} as citations_checked", f"({checked}) div 2 as citations_passed", "concat('Order of ', cast(cast(o_orderdate as date) as string)) as finding", "o_orderpriority as arm", "cast(null as string) as model",
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = queue.with_notes(cases(spark, sf_dir), notes(spark, sf_dir))
    found = queue.select(every, status=["new", "under_review"], kinds=["d1", "Splits", "vendor"], bands=["high", "medium"], verdicts=["likely_true_positive", "inconclusive"], search=" CUSTOMER ", least=100.0)
    return queue.page(found, number=2, size=20).select("case_id", "status", "anomaly_type", "band", "severity_prelim", "verdict", queue.excerpt(F.col("finding"), 12).alias("finding"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a change of its customer's case."""
    status = F.when(F.col("o_orderstatus") == "F", "dismissed").when(F.col("o_orderstatus") == "O", "confirmed").otherwise("under_review")
    said = F.when(F.col("o_orderpriority") == "1-URGENT", " ").when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" seen "), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("change_id"), status.alias("status"), said.alias("note"), F.lit(" ").alias("reviewer"))


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    start = cases(spark, sf_dir).select("case_id", "status", F.lit(None).cast("string").alias("reviewer_note"))
    return queue.review(start, changes(spark, sf_dir))


CHANGES_SQL = f"""{CASES_SQL}, ch AS (SELECT o_custkey::VARCHAR AS case_id, o_orderdate AS at, o_orderkey AS change_id, CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'confirmed' ELSE 'under_review' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN ' ' WHEN '2-HIGH' THEN ' seen ' || o_orderkey || ' ' END AS said, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
rv AS (SELECT case_id, 0::BIGINT AS i, status, NULL::VARCHAR AS note, NULL::VARCHAR AS previous, NULL::VARCHAR AS wanted, FALSE AS allowed, NULL::TIMESTAMP AS at, NULL::BIGINT AS change_id FROM cs
  UNION ALL SELECT rv.case_id, ch.i, CASE WHEN {{ok}} THEN ch.status ELSE rv.status END, CASE WHEN {{ok}} AND ch.said IS NOT NULL THEN nullif(trim(ch.said), '') ELSE rv.note END, rv.status, ch.status, {{ok}}, ch.at, ch.change_id FROM rv JOIN ch ON ch.case_id = rv.case_id AND ch.i = rv.i + 1)""".format(
    ok="(ch.status = rv.status OR rv.status = 'new' OR (rv.status = 'under_review' AND ch.status IN ('confirmed', 'dismissed')) OR (rv.status IN ('confirmed', 'dismissed') AND ch.status = 'under_review'))"
)


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds cases with a positive balance, after a run that raised every customer's figures by a tenth but found those with high bands no more."""
    now = cases(spark, sf_dir).withColumns({"row_ids": F.array(F.col("case_id").cast("long")), "detector_score": F.lit(0.5), "metadata": F.lit("{}")})
    old = now.where("amount_at_risk > 0").withColumns({"dataset": F.lit("set"), "run_id": F.lit("r1"), "reviewer_note": F.lit(None).cast("string")})
    new = now.where("band <> 'high'").withColumns({"amount_at_risk": F.round(F.col("amount_at_risk") * 1.1, 2), "band": F.lit("low"), "detector_score": F.lit(0.6)})
    return queue.save(old, new, "set", "r2").select("case_id", "run_id", "status", "band", "amount_at_risk", "investigated", "action")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.when(F.col("l_returnflag") == "R", "tool").otherwise("say").alias("kind"), F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens"), F.col("l_suppkey").alias("latency_ms"))


TRACES_SQL = "tr AS (SELECT l_orderkey AS note_id, count(*) FILTER (l_returnflag = 'R') AS tools, sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS tokens, sum(l_suppkey)::BIGINT AS latency_ms FROM lineitem GROUP BY 1)"


def agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    standing = queue.latest_notes(notes(spark, sf_dir)).withColumns({"deterministic_passed": F.col("citations_passed"), "semantic_passed": F.when(F.col("verdict").isNotNull(), F.col("citations_passed")), "retry_count": F.when(F.col("verification_status") == "unverified", 1).otherwise(0)})
    return review.agent_metrics(standing, traces(spark, sf_dir))


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = queue.with_notes(cases(spark, sf_dir), notes(spark, sf_dir))
    return review.triage(x.select("anomaly_type", (F.col("status") != "dismissed").alias("is_real"), "verdict"))


def _triage_sql() -> str:
    tally = ", ".join(f"count(*) FILTER ({'' if real else 'NOT '}is_real AND verdict = '{v}') AS {'real' if real else 'spurious'}_{v}" for real in (True, False) for v in review.OUTCOMES)
    rate = lambda a, b: f"round(({a}) / nullif({b}, 0), 3)"
    right, wrong = "likely_true_positive", "likely_false_positive"
    every = f"real_{right} + real_{wrong} + spurious_{right} + spurious_{wrong}"
    rates = f"""{rate(f'real_{right}', '"real"')} AS real_kept, {rate(f'real_{wrong}', '"real"')} AS real_wrongly_dismissed, {rate(f'spurious_{wrong}', 'spurious')} AS spurious_filtered, {rate('real_inconclusive + spurious_inconclusive', 'cases')} AS inconclusive,
  {rate('real_failed + spurious_failed', 'cases')} AS failed, {rate(f'real_{right} + spurious_{wrong}', every)} AS decisive_accuracy"""
    return f"""WITH {CASES_SQL}, {NOTES_SQL}, i AS (SELECT unnest([anomaly_type, 'all']) AS anomaly_type, status <> 'dismissed' AS is_real, coalesce(verdict, 'failed') AS verdict FROM cs LEFT JOIN la USING (case_id)),
t AS (SELECT anomaly_type, count(*) AS cases, count(*) FILTER (is_real) AS "real", count(*) FILTER (NOT is_real) AS spurious, {tally} FROM i GROUP BY 1) SELECT *, {rates} FROM t"""


#: Events as reviews: users are cases, what they do is a verdict, the event's number its reviewer.
SAID = "CASE event_type WHEN 'purchase' THEN 'plausible' WHEN 'click' THEN 'plausible' WHEN 'view' THEN 'implausible' WHEN 'error' THEN 'unclear' ELSE 'implausible' END"
REVIEWS_SQL = f"""rw AS (SELECT user_id::VARCHAR AS case_id, {SAID} AS verdict, 'p' || (event_id % 3) AS reviewer FROM events),
rn AS (SELECT case_id, verdict, count(*) AS n FROM rw GROUP BY 1, 2), rm AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS most, count(*) OVER (PARTITION BY case_id) AS kinds, sum(n) OVER (PARTITION BY case_id) AS votes FROM rn),
mj AS (SELECT case_id, CASE WHEN count(*) > 1 THEN 'unclear' ELSE min(verdict) END AS verdict, max(votes)::BIGINT AS n, max(kinds) > 1 AS disagreed FROM rm WHERE n = most GROUP BY 1)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as case_id", f"{SAID} as verdict", "concat('p', cast(event_id % 3 as string)) as reviewer")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as grades of their order's note; parts that do not apply are null."""
    score = lambda c, skip: F.when(~skip, F.floor(c) % 3)
    q, d = F.col("l_quantity"), F.col("l_discount")
    never = F.lit(False)
    parts = (score(q, never), score(q / 2, d > 0.09), score(q / 3, never), score(q / 4, d < 0.01), score(q / 5, never))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("grader"), *[c.alias(p) for c, p in zip(parts, review.PARTS, strict=True)])


def _rubric_sql() -> str:
    a, b, c, d, e = review.PARTS
    skip = {b: "l_discount > 0.09", d: "l_discount < 0.01"}
    cols = ", ".join(f"CASE WHEN NOT ({skip.get(p, 'FALSE')}) THEN floor(l_quantity / {i}) % 3 END AS {p}" for i, p in enumerate(review.PARTS, 1))
    each = " UNION ALL ".join([f"SELECT arm, '{p}' AS part, {p} AS score FROM g" for p in review.PARTS] + [f"SELECT arm, 'total', {' + '.join(review.PARTS)} FROM g"])
    return f"WITH g AS (SELECT o_orderpriority AS arm, {cols} FROM lineitem JOIN orders ON l_orderkey = o_orderkey), x AS ({each}) SELECT arm, part, count(score) AS n, round(avg(score), 9) AS mean FROM x GROUP BY 1, 2 HAVING count(score) > 0"


def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to show of every customer's orders, as if all tests had fired."""
    tx = orders(spark, sf_dir)
    by = tx.groupBy(F.col("vendor_key").alias("case_id")).agg(F.collect_list("row_id").alias("row_ids"), F.min("txn_date").alias("first_seen"))
    flagged = by.select("case_id", "row_ids", F.lit(True).alias("new_vendor_high_value"), "first_seen", F.lit("period_end,round_numbers,first_digit").alias("indicators"), F.lit(1).alias("digit"))
    return review.evidence_rows(flagged, tx, budget=6)


EVIDENCE_SQL = f"""WITH RECURSIVE {TXO_SQL}, v AS (SELECT vendor_key AS case_id, row_id, amount, txn_date, min(txn_date) OVER (PARTITION BY vendor_key) AS first_seen FROM txo),
l AS (SELECT case_id, row_id, amount, 0 AS b FROM v WHERE date_diff('day', first_seen, txn_date) BETWEEN 0 AND 90 UNION ALL SELECT case_id, row_id, amount, 1 FROM v WHERE month(txn_date) = 3 OR day(txn_date) > day(last_day(txn_date)) - 4
  UNION ALL SELECT case_id, row_id, amount, 2 FROM v WHERE amount % 1000 = 0 UNION ALL SELECT case_id, row_id, amount, 3 FROM v WHERE amount > 0 AND floor(amount / pow(10.0, floor(log10(amount)))) = 1 UNION ALL SELECT case_id, row_id, amount, 4 FROM v),
s AS (SELECT case_id, list({{'b': b, 'id': row_id}} ORDER BY b, amount DESC, row_id) AS l FROM l GROUP BY 1),
f AS (SELECT case_id, list_reduce(range(0, 30), lambda a, t: CASE WHEN len(a) < 6 AND len(list_filter(l, lambda x: x.b = t % 5 AND NOT list_contains(list_transform(a, lambda y: y.id), x.id))) > 0
  THEN list_append(a, list_filter(l, lambda x: x.b = t % 5 AND NOT list_contains(list_transform(a, lambda y: y.id), x.id))[1]) ELSE a END, []::STRUCT(b INTEGER, id BIGINT)[]) AS p FROM s),
o AS (SELECT case_id, unnest(range(1, len(p) + 1)) AS i, p FROM f)
SELECT case_id, i::INT AS "at", p[i].id AS row_id, ['new vendor', 'period end', 'round number', 'leading digit', 'largest'][p[i].b + 1] AS why FROM o"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts on every order in the ways in which notes write them: most right, some rounded, some wrong, some on rows that are not there."""
    rows = orders(spark, sf_dir)
    k = F.col("row_id") % 6
    money, day = F.format_number("amount", 2), F.col("txn_date")
    stated = F.when(k == 0, F.concat(F.lit("₹ "), money)).when(k == 1, F.concat(F.lit("Rs. "), F.format_number(F.round("amount", 1), 1))).when(k == 2, F.format_string("%.2f", F.col("amount") + 1)).when(k == 3, F.date_format(day, "dd-MM-yyyy")).when(k == 4, F.date_format(day, "d MMMM yyyy")).otherwise(F.concat(F.lit(' "'), F.upper("officer_id"), F.lit(". ")))
    field = F.when(k <= 2, "amount").when(k <= 4, "txn_date").otherwise("officer_id")
    facts = rows.select(F.col("row_id").alias("note_id"), F.lit(0).alias("claim_index"), "row_id", field.alias("field"), stated.alias("stated"))
    gone = rows.select(F.col("row_id").alias("note_id"), F.lit(1).alias("claim_index"), (-F.col("row_id") - 1).alias("row_id"), F.lit("amount").alias("field"), F.lit("1").alias("stated"))
    return facts.unionByName(gone)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_checks.check_citations(cited(spark, sf_dir), orders(spark, sf_dir), ("amount", "txn_date", "officer_id"))


CITED_SQL = f"""WITH {TXO_SQL}, f AS (SELECT row_id AS note_id, 0 AS claim_index, row_id, CASE WHEN row_id % 6 <= 2 THEN 'amount' WHEN row_id % 6 <= 4 THEN 'txn_date' ELSE 'officer_id' END AS field, TRUE AS row_exists, row_id % 6 <> 2 AS value_ok FROM txo
  UNION ALL SELECT row_id, 1, -row_id - 1, 'amount', FALSE, FALSE FROM txo) SELECT *, CASE WHEN NOT row_exists THEN 'row ' || row_id || ' does not exist' WHEN NOT value_ok THEN 'row ' || row_id || ' ' || field || ' differs' END AS problem FROM f"""


def released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release status of every order's note: its citations, a clause that is not in the policy for urgent ones, wording for high ones, a judge for shipped ones."""
    own = notes(spark, sf_dir).select("note_id", F.when(F.col("arm") == "2-HIGH", "It is a Duplicate payment.").otherwise("See the duplicate-payment register.").alias("text"), F.when(F.col("arm") == "1-URGENT", F.array(F.lit("SG-PP-9.9"), F.lit("SG-PP-4.4"))).otherwise(F.array(F.lit("SG-PP-4.4"))).alias("clauses"), "verification_status")
    known = spark.createDataFrame([("SG-PP-4.4",)], "clause_id string")
    checked = verified(spark, sf_dir).where("row_exists")
    judged = own.where("verification_status = 'verified'").select("note_id", F.lit(0).alias("claim_index"), (F.col("note_id") % 10 != 0).alias("supports"))
    return note_checks.report(own, checked, note_checks.note_checks(own, known), judged)


RELEASED_SQL = """WITH x AS (SELECT o_orderkey AS note_id, 1::BIGINT AS checked, (o_orderkey % 6 <> 2)::BIGINT AS passed, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS note_problems, o_orderstatus = 'F' AS judge_ran, (o_orderstatus = 'F' AND o_orderkey % 10 = 0)::BIGINT AS unsupported FROM orders),
y AS (SELECT *, checked - passed + note_problems + unsupported AS failures FROM x) SELECT *, CASE WHEN failures > 0 THEN 'failed_after_retries' WHEN judge_ran THEN 'verified' ELSE 'unverified' END AS verification_status FROM y"""


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import baseline

    tx = orders(spark, sf_dir)
    found = case_table.build(baseline.near_threshold(tx), "baseline", "split")
    out = note_checks.template_notes(found, tx).join(found.select("case_id", F.element_at("row_ids", 1).alias("row_id")), "case_id")
    return out.select("row_id", "finding", F.array_join("clauses", ",").alias("clauses"), F.col("facts")[0]["value"].cast("double").alias("fact"))


RESTATED_SQL = f"""WITH {TXO_SQL}, t AS (SELECT *, printf('%.2f', amount) AS x FROM txo WHERE amount >= 225000 AND amount < 250000)
SELECT row_id, 'Purchases from ' || vendor_name || ' on ' || txn_date || ', each below the approval limit, make ₹' || x[1:1] || ',' || x[2:3] || ',' || x[4:] || ' together (1 in all). Found by BASELINE with a score of 1.00.' AS finding, 'SG-PP-3.1,SG-PP-3.2' AS clauses, amount AS fact FROM t"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each region: its nations are sections with a clause each, and a table of thresholds."""
    n = table(spark, sf_dir, "nation")
    part = F.concat(F.lit("\n## "), "n_name", F.lit("\n\nWords ahead of any clause.\n\n**SG-PP-"), F.col("n_nationkey").cast("string"), F.lit(".1 — Buying in "), F.lower("n_name"), F.lit(".**\nFirst *line* of it.\n\n\n\n- a bullet.\n| a | **b** |\n|---|:-:|\n\n**SG-PP-"), F.col("n_nationkey").cast("string"), F.lit(".2 - Empty.**\n"))
    by = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("t")))), lambda x: x["t"]), "").alias("body"))
    rows = F.concat(F.lit("\n## Threshold summary\n\n| Parameter | Value | Clause | Used by |\n|---|---|---|---|\n| **Principal control threshold** | ₹2,50,000 | c1 | all |\n| Split detection window | "), (F.col("n_regionkey") + 14).cast("string"), F.lit(" days | c2 | d2 |\n| Heightened scrutiny windows | `3 and 7 days` | c3 | d2 |\n| Duplicate amount tolerance | 0.5% | c4 | d1 |\n\n## After\n| x | 1 day | y | z |\n"))
    return by.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("# Policy\n"), "body", rows).alias("text"))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes: clerks' priorities are models, and one line item of each order in three that is cited does not match."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("citations_checked"), F.count_if(F.col("l_linenumber") % 3 != 0).alias("citations_passed"))
    rows = table(spark, sf_dir, "orders").join(by, "o_orderkey", "left").select(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "P", "control").otherwise("agent").alias("arm"), "citations_checked", "citations_passed")
    return report.citation_validity(rows)


def kept_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes with a claim for each return flag, which states prices of line items, every fifth of them wrong."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.min("l_extendedprice").alias("l_extendedprice"))
    stated = F.when(F.col("l_linenumber") % 5 == 0, "1").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    fact = F.struct(row, F.lit("amount").alias("field"), stated.alias("stated"))
    claims = items.groupBy("l_orderkey", F.col("l_returnflag").alias("text")).agg(F.collect_list(fact).alias("cited"))
    made = claims.groupBy(F.col("l_orderkey").alias("note_id")).agg(F.array_sort(F.collect_list(F.struct("text", "cited"))).alias("claims"))
    flat = made.select("note_id", F.posexplode("claims").alias("claim_index", "c")).select("note_id", "claim_index", F.explode("c.cited").alias("f")).select("note_id", "claim_index", "f.*")
    known = items.select(row, F.col("l_extendedprice").alias("amount"))
    return note_checks.citation_rows(made, note_checks.check_citations(flat, known, ("amount",)))


def told_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a case of its orders, as a document."""
    tx = orders(spark, sf_dir)
    rows = tx.groupBy("vendor_key").agg(F.collect_list("row_id").alias("row_ids"))
    every = cases(spark, sf_dir).drop("vendor_key").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), ascii_key(F.col("c_name")).alias("vendor_key")), "case_id").join(rows, "vendor_key")
    cited = every.select("case_id", F.explode("row_ids").alias("row_id")).where("row_id % 2 = 0")
    return report.case_markdown(every, notes(spark, sf_dir), tx, cited, "7")


ENTRIES = {
    "citation_validity": (
        valid,
        """WITH c AS (SELECT l_orderkey, count(*) AS c, count(*) FILTER (l_linenumber % 3 <> 0) AS p FROM lineitem GROUP BY 1),
m AS (SELECT o_orderpriority AS model, count(*) AS notes, sum(c)::BIGINT AS checked, sum(p)::BIGINT AS passed FROM orders JOIN c ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1),
t AS (SELECT * FROM m ORDER BY notes DESC, model LIMIT 1)
SELECT model, notes, checked, round(passed / checked, 9) AS validity, printf('%.1f%% over %d note(s)', 100 * passed / checked, notes) AS quoted, (SELECT string_agg(x.model, ', ' ORDER BY x.model) FROM m x WHERE x.model <> t.model) AS others FROM t""",
    ),
    "citation_rows": (
        kept_citations,
        """WITH u AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2), t AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS i FROM u)
SELECT l_orderkey AS note_id, i::INT AS claim_index, l_returnflag AS claim, l_orderkey * 10 + l_linenumber AS row_id, '[{"field":"amount","stated":"' || CASE WHEN l_linenumber % 5 = 0 THEN '1' ELSE CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR END || '"}]' AS asserted, TRUE AS row_exists,
  l_linenumber % 5 <> 0 AS values_match, CASE WHEN l_linenumber % 5 = 0 THEN 'row ' || (l_orderkey * 10 + l_linenumber) || ' amount differs' END AS failure FROM t""",
    ),
    "case_markdown": (
        told_case,
        f"""WITH {CASES_SQL}, {NOTES_SQL}, {TXO_SQL}, o AS (SELECT * FROM cs LEFT JOIN la USING (case_id) WHERE case_id = '7'),
h AS (SELECT unnest(['# Case 7', '', '- Type: ' || anomaly_type, '- Detector: ' || detector, '- Status: ' || status, '- Severity: ' || band || ' (' || printf('%.2f', severity_prelim) || ')', '- At risk: ' || printf('%.2f', amount_at_risk), '- Verdict: ' || coalesce(verdict, '-'),
  '- Citations: ' || coalesce(citations_passed || ' of ' || citations_checked, '-'), '', coalesce(finding, 'No note yet.'), '', '| Row | Date | Amount | Cited |', '|---|---|---|---|']) AS text, unnest(range(1, 15)) AS line FROM o)
SELECT line, text FROM h UNION ALL SELECT 14 + row_number() OVER (ORDER BY o_orderdate, o_orderkey), '| ' || o_orderkey || ' | ' || o_orderdate::DATE || ' | ' || printf('%.2f', o_totalprice) || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE '' END || ' |' FROM orders WHERE o_custkey = 7""",
    ),
    "case_queue": (
        asked,
        f"""WITH {CASES_SQL}, {NOTES_SQL} SELECT case_id, status, anomaly_type, band, severity_prelim, verdict, CASE WHEN length(finding) <= 12 THEN finding ELSE regexp_replace(finding[1:11], '\\s+$', '') || '…' END AS finding FROM cs JOIN la USING (case_id)
WHERE status IN ('new', 'under_review') AND anomaly_type IN ('duplicate', 'split', 'vendor_flag') AND band IN ('high', 'medium') AND verdict IN ('likely_true_positive', 'inconclusive') AND amount_at_risk >= 100 ORDER BY severity_prelim DESC, case_id LIMIT 20 OFFSET 20""",
    ),
    "case_latest_note": (lambda s, d: queue.with_notes(cases(s, d), notes(s, d)).select("case_id", "note_id", "verdict"), f"WITH {CASES_SQL}, {NOTES_SQL} SELECT case_id, note_id, verdict FROM cs LEFT JOIN la USING (case_id)"),
    "case_kpis": (
        lambda s, d: queue.kpis(cases(s, d), notes(s, d)),
        f"""WITH {CASES_SQL}, {NOTES_SQL}, e AS (SELECT cs.*, verdict, verification_status FROM cs LEFT JOIN la USING (case_id)),
u AS (SELECT unnest([{{'n': 'type', 'v': anomaly_type}}, {{'n': 'band', 'v': band}}, {{'n': 'status', 'v': status}}, {{'n': 'verdict', 'v': verdict}}, {{'n': 'verification', 'v': verification_status}}]) AS f, amount_at_risk AS a FROM e),
t AS (SELECT unnest([{{'v': 'flagged', 'k': TRUE}}, {{'v': 'investigated', 'k': investigated}}, {{'v': 'queued', 'k': NOT investigated}}, {{'v': 'at_risk', 'k': status <> 'dismissed'}}, {{'v': 'confirmed', 'k': status = 'confirmed'}}]) AS f, amount_at_risk AS a FROM cs)
SELECT f.n AS name, f.v AS value, count(*) AS n, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS money FROM u WHERE f.v IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'total', f.v, count(*) FILTER (f.k), CAST(coalesce(sum(CAST(a AS DECIMAL(18,2))) FILTER (f.k), 0) AS DOUBLE) FROM t GROUP BY f.v""",
    ),
    "case_to_investigate": (lambda s, d: queue.to_investigate(cases(s, d), 25).select("case_id", "severity_prelim"), f"WITH {CASES_SQL} SELECT case_id, severity_prelim FROM cs WHERE status IN ('new', 'under_review') AND NOT investigated ORDER BY severity_prelim DESC, case_id LIMIT 25"),
    "case_final_severity": (
        lambda s, d: queue.apply_verdicts(cases(s, d), notes(s, d)).select("case_id", "severity_final", "band", "investigated", "dismissed_by_agent", "status"),
        f"""WITH {CASES_SQL}, {NOTES_SQL}, x AS (SELECT cs.*, verdict, round(greatest(CASE verdict WHEN 'likely_false_positive' THEN least(severity_prelim, 32.99) WHEN 'inconclusive' THEN least(severity_prelim, 65.99) ELSE severity_prelim END, 0), 2) AS f FROM cs LEFT JOIN la USING (case_id))
SELECT case_id, CASE WHEN verdict IS NOT NULL THEN f END AS severity_final, CASE WHEN verdict IS NULL THEN band ELSE {BAND.format('f')} END AS band, investigated OR verdict IS NOT NULL AS investigated, coalesce(verdict = 'likely_false_positive', FALSE) AS dismissed_by_agent, status FROM x""",
    ),
    "case_status_after": (lambda s, d: reviewed(s, d)[0], f"WITH RECURSIVE {CHANGES_SQL} SELECT case_id, arg_max(status, i) AS status, CASE WHEN max(i) > 0 THEN (list(note ORDER BY i DESC))[1] END AS reviewer_note FROM rv GROUP BY 1"),
    "case_review_history": (
        lambda s, d: reviewed(s, d)[1].select("case_id", "change_id", "previous", "status", "note", "reviewer", "allowed"),
        f"WITH RECURSIVE {CHANGES_SQL} SELECT case_id, change_id, previous, wanted AS status, note, 'Demo Reviewer' AS reviewer, allowed FROM rv WHERE i > 0",
    ),
    "case_save": (
        saved,
        f"""WITH {CASES_SQL}, o AS (SELECT * FROM cs WHERE amount_at_risk > 0), n AS (SELECT * FROM cs WHERE band <> 'high')
SELECT case_id, CASE WHEN n.case_id IS NOT NULL THEN 'r2' ELSE 'r1' END AS run_id, CASE WHEN o.case_id IS NULL THEN 'new' ELSE o.status END AS status, CASE WHEN o.case_id IS NOT NULL AND (o.investigated OR n.case_id IS NULL) THEN o.band ELSE 'low' END AS band,
  CASE WHEN n.case_id IS NOT NULL THEN round(n.amount_at_risk * 1.1, 2) ELSE o.amount_at_risk END AS amount_at_risk, coalesce(o.investigated, FALSE) AS investigated, CASE WHEN o.case_id IS NULL THEN 'inserted' WHEN n.case_id IS NULL THEN 'kept' ELSE 'refreshed' END AS action FROM o FULL JOIN n USING (case_id)""",
    ),
    "case_evidence": (
        lambda s, d: (lambda x: queue.evidence(x, x.groupBy(F.col("vendor_key").alias("case_id")).agg(F.collect_list("row_id").alias("row_ids")), x.where("amount > 300000").select(F.col("vendor_key").alias("case_id"), "row_id")))(orders(s, d)).select("case_id", "row_id", "amount", "cited"),
        f"WITH {TXO_SQL} SELECT vendor_key AS case_id, row_id, amount, amount > 300000 AS cited FROM txo",
    ),
    "case_nearby": (
        lambda s, d: (lambda x: queue.nearby(x, x.where("amount >= 225000 and amount < 250000").select(F.col("row_id").cast("string").alias("case_id"), "vendor_key", F.array("row_id").alias("row_ids")), 3))(orders(s, d)),
        f"WITH {TXO_SQL}, c AS (SELECT * FROM txo WHERE amount >= 225000 AND amount < 250000) SELECT c.row_id::VARCHAR AS case_id, t.row_id, abs(date_diff('day', c.txn_date, t.txn_date))::INT AS days, row_number() OVER (PARTITION BY c.row_id ORDER BY abs(date_diff('day', c.txn_date, t.txn_date)), t.row_id)::INT AS rank FROM c JOIN txo t ON t.vendor_key = c.vendor_key AND t.row_id <> c.row_id QUALIFY rank <= 3",
    ),
    "run_history": (
        lambda s, d: queue.history(queue.merge_runs(table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id"), F.lit("old").alias("kind"), F.col("o_orderdate").alias("started_at")), table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("run_id"), F.lit("new").alias("kind"), F.col("o_orderdate").alias("started_at")))).select("run_id", "kind"),
        "SELECT o_orderkey AS run_id, CASE WHEN o_totalprice > 200000 THEN 'new' ELSE 'old' END AS kind FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    ),
    "case_attempts": (lambda s, d: queue.attempts(table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("run_id"))), "SELECT l_orderkey AS case_id, count(DISTINCT l_suppkey) AS attempts FROM lineitem GROUP BY 1"),
    "trace_stats": (lambda s, d: review.trace_stats(traces(s, d)), f"WITH {TRACES_SQL} SELECT * FROM tr"),
    "agent_metrics": (
        agent,
        f"""WITH {NOTES_SQL}, {TRACES_SQL}, x AS (SELECT la.*, tools, tokens, latency_ms FROM la LEFT JOIN tr USING (note_id))
SELECT count(*) AS notes, round(sum(citations_passed) FILTER (citations_checked > 0) / nullif(sum(citations_checked) FILTER (citations_checked > 0), 0), 4) AS validity_deterministic,
  round(sum(citations_passed) FILTER (citations_checked > 0 AND verdict IS NOT NULL) / nullif(sum(citations_checked) FILTER (citations_checked > 0 AND verdict IS NOT NULL), 0), 4) AS validity_semantic,
  round(sum(tools) / count(tools), 4) AS avg_tool_calls, round(sum(tokens) / count(tools), 4) AS avg_tokens, round(sum(latency_ms / 1000) / count(tools), 4) AS avg_seconds, count(*) FILTER (verification_status = 'unverified') AS regenerated, 0::BIGINT AS failed FROM x""",
    ),
    "triage_metrics": (triaged, _triage_sql()),
    "review_majority": (lambda s, d: review.majority(reviews(s, d)), f"WITH {REVIEWS_SQL} SELECT * FROM mj"),
    "review_precision": (
        lambda s, d: (lambda x: x.select("detector", "flagged", "reviewed", *review.VERDICTS, *[F.round(c, 9).alias(c) for c in ("adjusted_precision", "low", "high")]))(review.precision(cases(s, d), reviews(s, d))),
        f"""WITH {CASES_SQL}, {REVIEWS_SQL}, t AS (SELECT detector, count(*) AS reviewed, count(*) FILTER (verdict = 'plausible') AS plausible, count(*) FILTER (verdict = 'implausible') AS implausible, count(*) FILTER (verdict = 'unclear') AS unclear FROM mj JOIN cs USING (case_id) GROUP BY 1),
f AS (SELECT detector, count(*) AS flagged FROM cs GROUP BY 1), j AS (SELECT *, plausible + implausible AS m, plausible / nullif(plausible + implausible, 0) AS p, 1.96::DOUBLE AS z FROM t JOIN f USING (detector))
SELECT detector, flagged, reviewed, plausible, implausible, unclear, round(p, 9) AS adjusted_precision, round(greatest((p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 0), 9) AS low, round(least((p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m), 1), 9) AS high FROM j""",
    ),
    "review_disagreements": (
        lambda s, d: review.disagreements(reviews(s, d), cases(s, d)),
        f"WITH {CASES_SQL}, {REVIEWS_SQL} SELECT case_id, array_to_string(list(reviewer || '=' || rw.verdict ORDER BY reviewer, rw.verdict), ';') AS verdicts, detector FROM rw JOIN mj USING (case_id) JOIN cs USING (case_id) WHERE disagreed GROUP BY case_id, detector",
    ),
    "review_sample": (
        lambda s, d: review.numbered(review.sample(cases(s, d), 5), ["detector", "case_id"]).select("number", "case_id", "detector"),
        f"WITH {CASES_SQL}, x AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY detector ORDER BY severity_prelim DESC, case_id) <= 5) SELECT row_number() OVER (ORDER BY detector, case_id)::INT AS number, case_id, detector FROM x",
    ),
    "review_spread": (
        lambda s, d: review.spread_over(cases(s, d), "detector", [F.desc("severity_prelim"), F.asc("case_id")], 7).select("case_id", "detector"),
        f"WITH {CASES_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY detector) AS n, row_number() OVER (PARTITION BY detector ORDER BY severity_prelim DESC, case_id) - 1 AS pos FROM cs) SELECT case_id, detector FROM x WHERE n <= 7 OR pos IN (SELECT (i * x.n) // 7 FROM range(7) r(i))",
    ),
    "review_sheet_check": (
        lambda s, d: review.checked_sheet(reviews(s, d).select(F.monotonically_increasing_id().alias("line"), F.concat(F.lit(" "), "case_id").alias("case_id"), F.when(F.col("reviewer") == "p0", F.upper("verdict")).when(F.col("reviewer") == "p1", F.lit("perhaps")).otherwise(F.lit(" ")).alias("verdict"), F.lit(" ").alias("comment")), cases(s, d).where("detector <> 'd4'")).groupBy("verdict", "problem").agg(F.count("*").alias("n")),
        f"WITH {CASES_SQL}, {REVIEWS_SQL}, f AS (SELECT case_id, CASE reviewer WHEN 'p0' THEN verdict ELSE 'perhaps' END AS verdict FROM rw WHERE reviewer <> 'p2') SELECT verdict, CASE WHEN case_id NOT IN (SELECT case_id FROM cs WHERE detector <> 'd4') THEN 'not in this batch' WHEN verdict = 'perhaps' THEN 'no verdict' END AS problem, count(*) AS n FROM f GROUP BY 1, 2",
    ),
    "rubric_means": (lambda s, d: review.rubric(grades(s, d), notes(s, d), cases(s, d)).withColumn("mean", F.round("mean", 9)), _rubric_sql()),
    "evidence_picks": (shown_rows, EVIDENCE_SQL),
    "citation_checks": (verified, CITED_SQL),
    "note_release": (released, RELEASED_SQL),
    "template_notes": (restated, RESTATED_SQL),
    "policy_clauses": (
        lambda s, d: policy.clauses(policies(s, d)),
        """SELECT n_regionkey AS doc_id, 'SG-PP-' || n_nationkey || '.1' AS clause_id, 'Buying in ' || lower(n_name) AS title, n_name AS section, 'First *line* of it.' || chr(10) || chr(10) || '- a bullet.' || chr(10) || '| a | **b** |' || chr(10) || '|---|:-:|' AS text,
  n_name || '. Buying in ' || lower(n_name) || '. First *line* of it. a bullet. a, b.' AS prose FROM nation""",
    ),
    "policy_thresholds": (
        lambda s, d: policy.thresholds(policies(s, d)).select("doc_id", "key", "clause", "used_by", F.array_join(F.transform("value", lambda x: F.format_string("%.4f", x)), ",").alias("value")),
        """SELECT DISTINCT n_regionkey AS doc_id, unnest(['principal_control_threshold', 'split_detection_window', 'heightened_scrutiny_windows', 'duplicate_amount_tolerance']) AS key, unnest(['c1', 'c2', 'c3', 'c4']) AS clause, unnest(['all', 'd2', 'd2', 'd1']) AS used_by,
  unnest(['250000.0000', printf('%.4f', n_regionkey + 14.0::DOUBLE), '3.0000,7.0000', '0.0050']) AS value FROM nation""",
    ),
    "policy_mismatches": (
        lambda s, d: policy.mismatches(policy.thresholds(policies(s, d)).where("doc_id = 1")).select("key", F.array_join(F.transform("policy", lambda x: F.format_string("%.0f", x)), ",").alias("policy"), F.array_join(F.transform("configured", lambda x: F.format_string("%.0f", x)), ",").alias("configured")),
        "SELECT * FROM (VALUES ('split_detection_window', '15', '14'), ('duplicate_date_window', NULL, '14'), ('new_vendor_period', NULL, '90')) v(key, policy, configured)",
    ),
    "notes_by_arm": (
        lambda s, d: queue.latest_notes(notes(s, d), arm="2-HIGH").select("case_id", "note_id"),
        f"WITH {NOTES_SQL} SELECT case_id, note_id FROM no JOIN orders ON o_orderkey = note_id WHERE o_orderpriority = '2-HIGH' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, note_id) = 1",
    ),
    "newest_by_key": (
        lambda s, d: store.latest(notes(s, d), ["case_id"], [F.desc("created_at"), F.asc("note_id")]).select("case_id", "note_id"),
        f"WITH {NOTES_SQL} SELECT case_id, note_id FROM no QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, note_id) = 1",
    ),
}
