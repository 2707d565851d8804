"""Queries of planted anomalies and of the figures that detectors are judged by, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import draws
from ..operators import detection, evaluate, inject, invoices, runs
from ..sources.adapter import TX_SQL, TXO_SQL, line_items, orders, table
from .detection import SCORED_SQL, joined

#: The provided line items are cheaper than what the policy has in mind.
CHEAP = Thresholds(approval=50_000.0)
PLAN = inject.Plan()


def draw_sql(purpose: str, *ids: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {', '.join(ids)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def new_id_sql(group: str, part: str) -> str:
    return f"('0x' || substr(md5({group} || '|' || {part}), 1, 15))::BIGINT"


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each type the plan asks for."""
    sizes = line_items(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("vendor_key").alias("v")).first()
    return spark.createDataFrame(sorted(PLAN.counts(sizes.n, sizes.v).items()), "anomaly_type string, n long")


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = inject.inflation(line_items(spark, sf_dir), 100, PLAN)
    return rows.select("row_id", "unit_price", "amount", "injection_group_id")


INFLATION_SQL = f"""WITH {TX_SQL}, z AS (SELECT item_category, count(*) AS n FROM tx GROUP BY 1 HAVING count(*) >= 20), f AS (SELECT tx.*, z.n, {draw_sql('inflation', 'row_id')} AS u FROM tx JOIN z USING (item_category) WHERE quantity > 0),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_category ORDER BY u, row_id) <= greatest(1, floor(0.05 * n))), g AS (SELECT *, row_number() OVER (ORDER BY u, row_id) AS no FROM c QUALIFY no <= 100)
SELECT row_id, round(unit_price * (1.5 + {draw_sql('inflation-factor', 'row_id')} * 1.5), 2) AS unit_price, round(quantity * round(unit_price * (1.5 + {draw_sql('inflation-factor', 'row_id')} * 1.5), 2), 2) AS amount, printf('INF-42-%04d', no) AS injection_group_id FROM g"""


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, truth, _ = inject.splits(line_items(spark, sf_dir), 100, PLAN, CHEAP)
    return rows.select("row_id", "injection_group_id", "quantity", "amount", "txn_date", "officer_id").join(truth.select(F.col("group_id").alias("injection_group_id"), F.element_at("source_row_ids", 1).alias("source"), F.col("amount_at_risk").alias("total")), "injection_group_id")


SPLITS_SQL = f"""WITH {TX_SQL}, f AS (SELECT *, greatest(3, ceil(amount / 47500.0)) AS low, least(6, quantity) AS high FROM tx WHERE amount >= 50000 AND amount <= 6 * 0.9 * 50000 AND quantity >= 3 AND quantity = floor(quantity)),
k AS (SELECT *, (low + floor({draw_sql('split-parts', 'row_id')} * (high - low + 1)))::INT AS k FROM f WHERE low <= high),
w AS (SELECT *, [0.5 + {draw_sql('split-weight', 'row_id', 'i')} FOR i IN range(1, k + 1)] AS w FROM k),
e AS (SELECT *, [i + floor((quantity - k) * list_sum(w[1:i]) / list_sum(w) + 1e-9)::INT FOR i IN range(1, k + 1)] AS edge FROM w),
q AS (SELECT *, [edge[i] - CASE WHEN i > 1 THEN edge[i - 1] ELSE 0 END FOR i IN range(1, k + 1)] AS q FROM e),
a AS (SELECT *, [(floor(q[i] * unit_price * 100 + 0.5) / 100)::DECIMAL(18,2) FOR i IN range(1, k)] AS head FROM q),
b AS (SELECT *, list_append(head, (round(amount, 2)::DECIMAL(18,2) - list_sum(head))::DECIMAL(18,2)) AS parts FROM a),
c AS (SELECT *, {draw_sql('split', 'row_id')} AS u FROM b WHERE list_min(parts) > 0 AND list_max(parts) < 49000),
g AS (SELECT *, row_number() OVER (ORDER BY u, row_id) AS no FROM c QUALIFY no <= 100),
d AS (SELECT *, printf('SPL-42-%04d', no) AS gid, list_sort([floor({draw_sql('split-day', 'row_id', 'i')} * 11)::INT FOR i IN range(1, k + 1)]) AS days,
  greatest((SELECT min(txn_date) FROM tx), least((SELECT max(txn_date) FROM tx), txn_date - floor({draw_sql('split-start', 'row_id')} * 3)::INT)) AS start FROM g),
r AS (SELECT *, unnest(range(1, k + 1)) AS i FROM d),
t AS (SELECT *, greatest((SELECT min(txn_date) FROM tx), least((SELECT max(txn_date) FROM tx), start + days[i])) AS day FROM r)
SELECT {new_id_sql('gid', 'i')} AS row_id, gid AS injection_group_id, q[i]::DOUBLE AS quantity, parts[i]::DOUBLE AS amount, CAST(day + CASE WHEN isodow(day) >= 6 THEN (8 - isodow(day))::INT ELSE 0 END AS DATE) AS txn_date, officer_id, row_id AS source, t.amount AS total FROM t"""


def rebooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, truth = inject.duplicates(line_items(spark, sf_dir), 200, PLAN)
    return truth.select("group_id", joined(), F.element_at("source_row_ids", 1).alias("source"), "vendor_key", F.round("amount_at_risk", 2).alias("amount_at_risk"))


DUPLICATES_SQL = f"""WITH {TX_SQL}, g AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('duplicate', 'row_id')}, row_id) AS no FROM tx QUALIFY no <= 200),
c AS (SELECT *, printf('DUP-42-%04d', no) AS gid, CASE WHEN {draw_sql('duplicate-copies', 'row_id')} < 0.1 THEN 2 ELSE 1 END AS n FROM g)
SELECT gid AS group_id, array_to_string(list_concat([row_id], [{new_id_sql('gid', 'i')} FOR i IN range(1, n + 1)]), ',') AS row_ids, row_id AS source, vendor_key, round(amount * n, 2) AS amount_at_risk FROM c"""


def planted_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, rows and repeated ids of each planted type, and how the table's size changed, for a plan that all finds room."""
    tx = line_items(spark, sf_dir)
    found, truth, _ = inject.inject(tx, PLAN, CHEAP)
    rows = found.groupBy(F.coalesce("injection_type", F.lit("clean")).alias("kind")).agg(F.count_distinct("row_id").alias("n_ids"), F.count("*").alias("n_rows"))
    groups = truth.groupBy(F.col("anomaly_type").alias("kind")).agg(F.count("*").alias("groups"))
    return rows.join(groups, "kind", "left").select("kind", (F.col("n_ids") == F.col("n_rows")).alias("ids_are_keys"), F.coalesce("groups", F.lit(0)).alias("groups"))


COUNTS_SQL = """pc AS (SELECT greatest(1, round_even(0.01 * count(*), 0)) AS g, greatest(4, round_even(0.02 * count(DISTINCT vendor_key), 0)) AS v FROM tx),
pl AS (SELECT 'split' AS kind, round_even(g * 0.2, 0)::BIGINT AS n FROM pc UNION ALL SELECT 'inflation', round_even(g * 0.3, 0)::BIGINT FROM pc UNION ALL SELECT 'duplicate', round_even(g * 0.5, 0)::BIGINT FROM pc UNION ALL SELECT 'vendor_flag', v::BIGINT FROM pc)"""


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's name as a firm's, in every way in which names are written differently."""
    name = F.concat(F.initcap(F.regexp_replace("s_name", r"\d+#?|#", " Works ")), F.lit("Pvt Ltd"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    u = lambda p: draws.draw(7, p, F.col("s_suppkey"))
    ways = {"suffix": draws.swapped_suffix(F.col("name"), u("a")), "case": draws.recased(F.col("name"), u("b")), "honorific": draws.honoured(F.col("name"), u("c")), "blank": draws.spaced(F.col("name"), u("d"))}
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s.]", ""))
    kept = {"suffix": plain(F.regexp_replace("suffix", "(?i)private|pvt", "p")) == plain(F.regexp_replace(F.regexp_replace("name", "(?i)pvt", "p"), "(?i)ltd", "ltd")), "case": F.lower("case") == F.lower("name"), "honorific": F.col("honorific").rlike(r"^M/[sS]\.? ") & F.col("honorific").endswith(F.col("name")), "blank": plain(F.col("blank")) == plain(F.col("name"))}
    changed = rows.withColumns(ways | {"typo": draws.typo(F.col("name"), u("e"), u("f"))})
    slip = (F.levenshtein("typo", "name") <= 2) & (F.substring("typo", 1, 1) == F.substring("name", 1, 1)) & (F.abs(F.length("typo") - F.length("name")) <= 1)
    return changed.select("s_suppkey", *[((F.col(k) != F.col("name")) & ok).alias(k) for k, ok in kept.items() if k != "suffix"], ((F.col("suffix") != F.col("name")) & F.col("suffix").rlike("(?i)(pvt|private)[. ]*(ltd|limited)[.]?$")).alias("suffix"), slip.alias("typo"))


# ---------------------------------------------------------------- matching and metrics


def found_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split runs as cases, and each vendor as a flag."""
    tx = line_items(spark, sf_dir)
    split = runs.scored_runs(tx).select(F.lit("split").alias("anomaly_type"), F.concat_ws("-", "vendor_key", "officer_id", F.col("run_id").cast("string")).alias("case_id"), "score", F.transform("row_ids", lambda x: x).alias("row_ids"), "vendor_key")
    flag = tx.groupBy("vendor_key").agg(F.collect_list("row_id").alias("row_ids"), F.round(F.avg((F.col("quantity") > 25).cast("double")), 9).alias("score"))
    return split.unionByName(flag.select(F.lit("vendor_flag").alias("anomaly_type"), F.concat(F.lit("v-"), "vendor_key").alias("case_id"), "score", "row_ids", "vendor_key"))


def known_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a vendor and month as groups of splits, and as flags the vendors that have large orders in March."""
    tx = line_items(spark, sf_dir)
    month = tx.groupBy("vendor_key", F.trunc("txn_date", "MM").alias("m")).agg(F.collect_list("row_id").alias("rows"))
    flag = tx.where("month(txn_date) = 3 and quantity >= 45").groupBy("vendor_key").agg(F.collect_list("row_id").alias("rows"))
    return month.select(F.lit("split").alias("anomaly_type"), F.concat_ws("-", "vendor_key", F.col("m").cast("string")).alias("group_id"), "rows", "vendor_key").unionByName(
        flag.select(F.lit("vendor_flag").alias("anomaly_type"), F.concat(F.lit("g-"), "vendor_key").alias("group_id"), "rows", "vendor_key")
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.greedy(evaluate.candidate_matches(found_runs(spark, sf_dir), known_groups(spark, sf_dir)))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.metrics(found_runs(spark, sf_dir), known_groups(spark, sf_dir))
    return out.select("anomaly_type", "granularity", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "pr_auc")])


MATCH_SQL = f"""{SCORED_SQL}, cs AS (SELECT 'split' AS kind, vendor_key || '-' || officer_id || '-' || ids[1] AS case_id, score, ids AS row_ids, vendor_key FROM sr
  UNION ALL SELECT 'vendor_flag', 'v-' || vendor_key, round(avg((quantity > 25)::INT), 9), list(row_id), vendor_key FROM tx GROUP BY vendor_key),
gs AS (SELECT 'split' AS kind, vendor_key || '-' || date_trunc('month', txn_date)::DATE AS group_id, list(row_id) AS rows_, vendor_key FROM tx GROUP BY vendor_key, date_trunc('month', txn_date)
  UNION ALL SELECT 'vendor_flag', 'g-' || vendor_key, list(row_id), vendor_key FROM tx WHERE month(txn_date) = 3 AND quantity >= 45 GROUP BY vendor_key),
cr AS (SELECT case_id, score, len(row_ids) AS n, unnest(row_ids) AS r FROM cs WHERE kind = 'split'), gr_ AS (SELECT group_id, unnest(rows_) AS r FROM gs WHERE kind = 'split'),
ed AS (SELECT case_id, group_id, max(score) AS score, count(*) AS o, (max(n) - count(*)) / max(n) AS sp FROM cr JOIN gr_ USING (r) GROUP BY 1, 2 HAVING (max(n) - count(*)) / max(n) <= 0.5
  UNION ALL SELECT case_id, group_id, score, 1, 0 FROM cs JOIN gs USING (kind, vendor_key) WHERE kind = 'vendor_flag'),
od AS (SELECT case_id, row_number() OVER (ORDER BY max(score) DESC, case_id) AS i FROM ed GROUP BY 1),
gd AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS case_id, NULL::VARCHAR AS group_id, []::VARCHAR[] AS gone
  UNION ALL SELECT n.i, n.case_id, n.g, CASE WHEN n.g IS NULL THEN gd.gone ELSE list_append(gd.gone, n.g) END FROM gd, LATERAL (SELECT any_value(od.i) AS i, any_value(od.case_id) AS case_id, arg_min(ed.group_id, (-ed.o, ed.sp, ed.group_id)) FILTER (NOT list_contains(gd.gone, ed.group_id)) AS g FROM od JOIN ed USING (case_id) WHERE od.i = gd.i + 1) n WHERE n.i IS NOT NULL),
mt AS (SELECT case_id, group_id FROM gd WHERE group_id IS NOT NULL)"""
RATES_SQL = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"
METRICS_SQL = f"""WITH RECURSIVE {MATCH_SQL}, rk AS (SELECT kind, score, case_id IN (SELECT case_id FROM mt) AS hit FROM cs), gn AS (SELECT kind, count(*) AS n FROM gs GROUP BY 1),
cc AS (SELECT kind, 'case' AS granularity, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, any_value(gn.n) - count(*) FILTER (hit) AS fn FROM rk JOIN gn USING (kind) GROUP BY 1),
cw AS (SELECT DISTINCT kind, unnest(row_ids) AS r FROM cs), gw AS (SELECT DISTINCT kind, unnest(rows_) AS r FROM gs),
rc_ AS (SELECT coalesce(cw.kind, gw.kind) AS kind, 'row' AS granularity, count(*) FILTER (cw.r IS NOT NULL AND gw.r IS NOT NULL) AS tp, count(*) FILTER (gw.r IS NULL) AS fp, count(*) FILTER (cw.r IS NULL) AS fn FROM cw FULL JOIN gw ON cw.kind = gw.kind AND cw.r = gw.r GROUP BY 1),
al AS (SELECT * FROM cc UNION ALL SELECT * FROM rc_), ev AS (SELECT * FROM al UNION ALL SELECT 'all', granularity, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM al GROUP BY granularity),
st AS (SELECT kind, score, count(*) FILTER (hit) AS up, count(*) AS n FROM (SELECT * FROM rk UNION ALL SELECT 'all', score, hit FROM rk) GROUP BY 1, 2),
ar AS (SELECT kind, sum(up * ups / ns) AS area FROM (SELECT *, sum(up) OVER w AS ups, sum(n) OVER w AS ns FROM st WINDOW w AS (PARTITION BY kind ORDER BY score DESC)) GROUP BY 1),
rt_ AS (SELECT ev.*, {RATES_SQL}, CASE WHEN granularity = 'case' THEN CASE WHEN tp + fn > 0 THEN area / (tp + fn) ELSE 0 END END AS pr_auc FROM ev LEFT JOIN ar USING (kind))
SELECT kind AS anomaly_type, granularity, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(pr_auc, 9) AS pr_auc FROM rt_"""

OWNERS = {"d1": "duplicate", "d2": "split", "d3": "inflation", "d4": "vendor_flag"}


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as if of runs: seeds are line numbers, detectors go by ship status and flag."""
    rows = table(spark, sf_dir, "lineitem")
    d = F.when(F.col("l_returnflag") == "R", "d1").when(F.col("l_returnflag") == "A", "d2").when(F.col("l_linestatus") == "F", "d3").otherwise("d4")
    kind = F.create_map(*[F.lit(x) for kv in OWNERS.items() for x in kv])
    counts = rows.groupBy(F.col("l_linenumber").alias("seed"), d.alias("detector")).agg(F.count_if(F.col("l_quantity") > 20).alias("tp"), F.count_if(F.col("l_tax") > 0.05).alias("fp"), F.count_if(F.col("l_discount") > 0.08).alias("fn"))
    return evaluate.with_rates(counts.withColumns({"anomaly_type": kind[F.col("detector")], "granularity": F.lit("case")}))


SEEDED_SQL = f"""cn AS (SELECT l_linenumber AS seed, CASE WHEN l_returnflag = 'R' THEN 'd1' WHEN l_returnflag = 'A' THEN 'd2' WHEN l_linestatus = 'F' THEN 'd3' ELSE 'd4' END AS detector,
  count(*) FILTER (l_quantity > 20) AS tp, count(*) FILTER (l_tax > 0.05) AS fp, count(*) FILTER (l_discount > 0.08) AS fn FROM lineitem GROUP BY 1, 2)"""


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of line numbers, as coders, on orders: shares of three values."""
    rated = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("coder"), F.when(F.col("l_quantity") < 45, (F.floor("l_quantity") % 3).cast("int")).alias("value"))
    a, b = (evaluate.krippendorff(rated, ordinal=o) for o in (False, True))
    plain = evaluate.agreement(rated).first()
    return spark.createDataFrame([(round(float(a), 9), round(float(b), 9), plain.units, round(plain.exact, 9))], "nominal double, ordinal double, units long, exact double")


ALPHA_SQL = """WITH v AS (SELECT l_orderkey AS u, (floor(l_quantity) % 3)::INT AS v FROM lineitem WHERE l_quantity < 45), m AS (SELECT u, count(*) AS m FROM v GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT u, v, count(*) AS n, any_value(m) AS m FROM v JOIN m USING (u) GROUP BY 1, 2), t AS (SELECT v, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT sum(n) AS n FROM t),
d AS (SELECT a.v AS x, b.v AS y, (a.v <> b.v)::INT AS nom, ((SELECT sum(n) FROM t WHERE t.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) - (a.n + b.n) / 2) ** 2 AS ord, a.n * b.n AS w FROM t a, t b),
o AS (SELECT a.v AS x, b.v AS y, sum(a.n * (b.n - (a.v = b.v)::INT) / (a.m - 1)) AS o FROM c a JOIN c b ON a.u = b.u GROUP BY 1, 2),
e AS (SELECT 1 - ((SELECT n FROM s) - 1) * sum(coalesce(o, 0) * nom) / sum(w * nom) AS nominal, 1 - ((SELECT n FROM s) - 1) * sum(coalesce(o, 0) * CASE WHEN x = y THEN 0 ELSE ord END) / sum(w * CASE WHEN x = y THEN 0 ELSE ord END) AS ordinal FROM d LEFT JOIN o USING (x, y)),
p AS (SELECT count(*) AS units, avg((k = 1)::INT) AS exact FROM (SELECT u, count(DISTINCT v) AS k FROM c GROUP BY 1))
SELECT round(nominal, 9) AS nominal, round(ordinal, 9) AS ordinal, units, round(exact, 9) AS exact FROM e, p"""

ENTRIES = {
    "invoice_numbers": (
        lambda s, d: invoices.numbered(orders(s, d)),
        f"""WITH {TXO_SQL}, y AS (SELECT row_id, vendor_key, txn_date, year(txn_date) - (month(txn_date) < 4)::INT AS fy FROM txo),
n AS (SELECT *, row_number() OVER (PARTITION BY vendor_key ORDER BY txn_date, row_id) AS seq, row_number() OVER (PARTITION BY vendor_key, fy ORDER BY txn_date, row_id) AS year_seq FROM y)
SELECT row_id, vendor_key, txn_date, seq, year_seq, printf('INV-%05d', seq) AS plain, lpad((fy % 100)::VARCHAR, 2, '0') || '-' || lpad(((fy + 1) % 100)::VARCHAR, 2, '0') || '/' || printf('%03d', year_seq) AS by_year FROM n""",
    ),
    "inject_plan": (planned, f"WITH {TX_SQL}, {COUNTS_SQL} SELECT kind AS anomaly_type, n FROM pl"),
    "inject_inflation": (raised, INFLATION_SQL),
    "inject_splits": (cut, SPLITS_SQL),
    "inject_duplicates": (rebooked, DUPLICATES_SQL),
    "service_categories": (
        lambda s, d: inject.service_categories(line_items(s, d), 1000, 5, (20, 30)),
        f"WITH {TX_SQL} SELECT item_category, median(unit_price) AS price, arg_min(item_desc, row_id) AS item_desc FROM tx GROUP BY 1 HAVING median(quantity) BETWEEN 20 AND 30 AND median(unit_price) >= 1000 AND count(*) >= 5",
    ),
    "inject_table": (planted_shape, f"WITH {TX_SQL}, {COUNTS_SQL} SELECT kind, TRUE AS ids_are_keys, n AS groups FROM pl UNION ALL SELECT 'clean', TRUE, 0"),
    "name_variants": (perturbed, 'SELECT s_suppkey, TRUE AS "case", TRUE AS honorific, TRUE AS blank, TRUE AS suffix, TRUE AS typo FROM supplier'),
    "eval_matches": (matches, f"WITH RECURSIVE {MATCH_SQL} SELECT case_id, group_id FROM mt"),
    "eval_metrics": (figures, METRICS_SQL),
    "eval_suite": (
        lambda s, d: evaluate.suite(seeded(s, d), OWNERS).select("seed", "granularity", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]),
        f"WITH {SEEDED_SQL}, p AS (SELECT seed, 'case' AS granularity, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cn GROUP BY 1 HAVING count(*) = 4), r AS (SELECT *, {RATES_SQL} FROM p) SELECT seed, granularity, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM r",
    ),
    "eval_over_seeds": (
        lambda s, d: (lambda x: x.select("detector", *[F.round(c, 9).alias(c) for c in x.columns if c != "detector"]))(evaluate.over_seeds(seeded(s, d), ["detector"])),
        f"WITH {SEEDED_SQL}, r AS (SELECT *, {RATES_SQL} FROM cn) SELECT detector, round(avg(precision), 9) AS precision_mean, round(stddev_samp(precision), 9) AS precision_sd, round(avg(recall), 9) AS recall_mean, round(stddev_samp(recall), 9) AS recall_sd, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_sd FROM r GROUP BY 1 HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM cn)",
    ),
    "agreement_alpha": (alphas, ALPHA_SQL),
    "detection_summary": (
        lambda s, d: detection.summary(detection.run_detection(line_items(s, d), ("d2",), Thresholds(split_score=0.6))),
        f"WITH RECURSIVE {SCORED_SQL} SELECT 'd2' AS detector, count(*) AS n_cases, sum(n_parts)::BIGINT AS n_rows, CAST(sum(CAST(total AS DECIMAL(24,4))) AS DOUBLE) AS at_risk FROM sr WHERE score >= 0.6",
    ),
}
