"""Every query of the audit operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import calculator, text
from ..functions.stats import wilson
from ..operators import baseline, cases, evaluate, explore, indexes, ingest, retrieval, runs, store
from . import detection, intake, reports, review, scoring, streams
from ..sources.scratch import shared_path
from ..sources.adapter import AUDIT_FIELDS, TX_SQL, TXO_SQL, ascii_key, line_items, orders, table

Query = Callable[[SparkSession, str], DataFrame]
SEVERITY_SQL = "round(100 * 1.0 * least(ln(1 + {0}) / ln(1 + 1e7), 1.0), 2)"
RAW_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a messy text export: money marks, two date formats, blanks and defects by order number."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("_row"),
        F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("  Customer "), F.col("o_custkey").cast("string"), F.lit(" Ltd "))).alias("Supplier"),
        F.when(k % 19 == 0, "N/A").when(k % 23 == 0, "0.00").when(k % 2 == 0, F.concat(F.lit("Rs. "), amount)).otherwise(F.concat(F.lit("₹ "), amount)).alias("Amount"),
        F.when(k % 29 == 0, "31-02-2024").when(k % 3 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Date"),
        F.when(k % 5 == 0, "NA").otherwise((k % 50).cast("string")).alias("Qty"),
    )


MAPPING = ingest.Mapping({"vendor_name": "Supplier", "amount": "Amount", "txn_date": "Date", "quantity": "Qty"}, RAW_FORMATS)
RAW_SQL = r"""raw AS (SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Customer ' || o_custkey || ' Ltd' END AS vendor_name,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS txn_date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS quantity FROM orders),
st AS (SELECT *, CASE WHEN vendor_name IS NULL THEN 'missing_vendor_name' WHEN amount IS NULL THEN 'unparseable_amount' WHEN amount <= 0 THEN 'non_positive_amount' WHEN txn_date IS NULL THEN 'unparseable_date' END AS drop_reason FROM raw)"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stage(raw_orders(spark, sf_dir), MAPPING, ascii_key(F.coalesce("vendor_name", F.lit(""))))


def ids(c: str = "row_ids") -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias("row_ids")


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baseline.near_threshold(orders(spark, sf_dir))
    return cases.build(found, "baseline", "split").select("case_id", F.element_at("row_ids", 1).alias("row_id"), "severity_prelim", "band", "amount_at_risk")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("verdict"))


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    n = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return n.select("source", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


CALCULATIONS = ("1 + 2 * 3", "-(2,500 - ₹500) / 8", "2 ** 2 ** 2", "7 % 4 + .5", "-7 % 4", "-2 ** 2", "1e3 * 2")
BM25_WORDS = ["the", "of", "license", "version", "the"]


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), BM25_WORDS, 20)


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes.write_lexical(table(spark, sf_dir, "documents"), path := shared_path(spark, "lexical"))
    return indexes.search_lexical(spark, path, BM25_WORDS, 20)


def cosine_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes.write_vectors(table(spark, sf_dir, "embeddings"), path := shared_path(spark, "vectors"))
    return indexes.search_vectors(spark, path, one_vector(spark, sf_dir), 20)[0]


def one_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine(table(spark, sf_dir, "embeddings"), one_vector(spark, sf_dir), 20)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda words: retrieval.bm25(table(spark, sf_dir, "documents"), words, 5).select(F.col("doc_id").alias("id"), "score")
    return retrieval.fuse([by(["the", "of"]), by(["license", "version"])])


BM25_CTE = """w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9₹.,]+'), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b, len(list_filter(w, lambda x: x = 'license')) AS c, len(list_filter(w, lambda x: x = 'version')) AS d FROM w),
s AS (SELECT count(*) AS n, sum(l) AS t, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc, count(*) FILTER (d > 0) AS dd FROM r),
p AS (SELECT doc_id, a, b, c, d, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * l * n / t)) AS pa, ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * l * n / t)) AS pb,
  ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * l * n / t)) AS pc, ln(1 + (n - dd + 0.5) / (dd + 0.5)) * d * 2.5 / (d + 1.5 * (0.25 + 0.75 * l * n / t)) AS pd FROM r, s)"""

DIGIT = "CAST(floor(amount / pow(10.0, floor(log10(amount)))) AS INTEGER)"
MONEY = "CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)"

_ENTRIES: dict[str, tuple[Query, str | None]] = {
    "tx_audit_view": (lambda s, d: line_items(s, d).select(*AUDIT_FIELDS), f"WITH {TX_SQL} SELECT * FROM tx"),
    "tx_orders_view": (lambda s, d: orders(s, d).select("row_id", "vendor_key", "amount", "txn_date", "officer_id", "item_category"), f"WITH {TXO_SQL} SELECT row_id, vendor_key, amount, txn_date, officer_id, item_category FROM txo"),
    "baseline_duplicates": (
        lambda s, d: baseline.duplicates(line_items(s, d), by_invoice=False).select("name", "amount", "n", ids(), "at_risk"),
        f"WITH {TX_SQL} SELECT lower(trim(vendor_name)) AS name, amount, count(*) AS n, array_to_string(list_sort(list(row_id)), ',') AS row_ids, amount * (count(*) - 1) AS at_risk FROM tx GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "baseline_near_threshold": (lambda s, d: baseline.near_threshold(orders(s, d)).select("row_id", "vendor_key", "amount", "at_risk"), f"WITH {TXO_SQL} SELECT row_id, vendor_key, amount, amount AS at_risk FROM txo WHERE amount >= 225000 AND amount < 250000"),
    "baseline_inflation": (
        lambda s, d: baseline.inflation(line_items(s, d)).select("row_id", "vendor_key", "item_category", "unit_price", F.round("mean_price", 6).alias("mean_price"), F.round("at_risk", 4).alias("at_risk")),
        f"WITH {TX_SQL}, m AS (SELECT item_category, avg(unit_price) AS mean_price FROM tx GROUP BY 1 HAVING count(*) >= 2) SELECT row_id, vendor_key, item_category, unit_price, round(mean_price, 6) AS mean_price, round((unit_price - mean_price) * coalesce(quantity, 1), 4) AS at_risk FROM tx JOIN m USING (item_category) WHERE unit_price > 2 * mean_price",
    ),
    "baseline_round_vendors": (
        lambda s, d: baseline.round_vendors(line_items(s, d), unit=5, share=0.001),
        f"WITH {TX_SQL} SELECT vendor_key, count(*) AS n, count(*) FILTER (amount % 5 = 0) AS n_round, coalesce(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (amount % 5 = 0) AS DOUBLE), 0.0) AS at_risk FROM tx GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (amount % 5 = 0) / count(*) >= 0.001",
    ),
    "case_severity_bands": (
        lambda s, d: rule_cases(s, d).drop("case_id"),
        f"WITH {TXO_SQL}, c AS (SELECT row_id, {SEVERITY_SQL.format('amount')} AS severity_prelim, amount AS amount_at_risk FROM txo WHERE amount >= 225000 AND amount < 250000) SELECT *, CASE WHEN severity_prelim >= 66 THEN 'high' WHEN severity_prelim >= 33 THEN 'medium' ELSE 'low' END AS band FROM c",
    ),
    "ingest_clean": (lambda s, d: ingest.canonical(staged(s, d), MAPPING).select("_row", "vendor_name", "amount", "txn_date", "quantity"), f"WITH {RAW_SQL} SELECT _row, vendor_name, amount, txn_date, quantity FROM st WHERE drop_reason IS NULL"),
    "ingest_drop_reasons": (
        lambda s, d: ingest.drop_counts(staged(s, d)),
        f"WITH {RAW_SQL} SELECT r AS drop_reason, count(drop_reason) AS n FROM (VALUES ('missing_vendor_name'), ('unparseable_amount'), ('non_positive_amount'), ('unparseable_date'), ('empty_vendor_key')) v(r) LEFT JOIN st ON drop_reason = r GROUP BY 1",
    ),
    "dataset_card": (
        lambda s, d: ingest.card(orders(s, d), DEFAULT.approval),
        f"WITH {TXO_SQL} SELECT count(*) AS n_rows, {MONEY} AS total, min(amount) AS least, median(amount) AS median, (SELECT amount FROM (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS r, count(*) OVER () AS n FROM txo) WHERE r = round_even(0.95 * (n - 1), 0)) AS p95, max(amount) AS most, count(*) FILTER (amount >= 250000) AS n_threshold, count(DISTINCT vendor_name) AS n_names, count(DISTINCT vendor_key) AS n_keys, count(DISTINCT officer_id) AS n_officers, count(DISTINCT item_category) AS n_categories, min(txn_date) AS first_date, max(txn_date) AS last_date FROM txo",
    ),
    "null_rates": (
        lambda s, d: ingest.null_rates(staged(s, d), ("vendor_name", "amount_num", "day", "quantity_num")),
        f"WITH {RAW_SQL} SELECT f AS field, k AS n_null, k / n AS rate FROM (SELECT count(*) AS n, unnest(['vendor_name', 'amount_num', 'day', 'quantity_num']) AS f, unnest([count(*) - count(vendor_name), count(*) - count(amount), count(*) - count(txn_date), count(*) - count(quantity)]) AS k FROM st)",
    ),
    "intake_date_formats": (
        lambda s, d: ingest.date_formats(raw_orders(s, d), "Date", {"iso": "yyyy-MM-dd", "day_first": "dd/MM/yyyy"}),
        "SELECT f AS format, k AS parsed, k >= greatest(1, floor(0.95 * n)) AS fits FROM (SELECT count(*) AS n, unnest(['iso', 'day_first']) AS f, unnest([count(*) FILTER (o_orderkey % 29 <> 0 AND o_orderkey % 3 <> 0), count(*) FILTER (o_orderkey % 29 <> 0 AND o_orderkey % 3 = 0)]) AS k FROM orders)",
    ),
    "vendor_collapse_groups": (
        lambda s, d: ingest.collapsed_names(table(s, d, "part").select(F.col("p_brand").alias("vendor_key"), F.col("p_name").alias("vendor_name"))).select("vendor_key", "n_names", F.array_join("names", "|").alias("names")),
        "WITH x AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT p_brand AS vendor_key, count(*) AS n_names, array_to_string(list_sort(list(p_name))[1:6], '|') AS names FROM x GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 8",
    ),
    "benford": (
        lambda s, d: explore.benford(line_items(s, d)),
        f"WITH {TX_SQL}, a AS (SELECT DISTINCT amount FROM tx WHERE amount > 0), c AS (SELECT {DIGIT} AS digit, count(*) AS n FROM a GROUP BY 1) SELECT digit, n, n / sum(n) OVER () AS share, round(log10(1 + 1.0::DOUBLE / digit), 9) AS expected FROM c",
    ),
    "vendor_profile": (
        lambda s, d: explore.vendor_profiles(line_items(s, d)),
        f"WITH {TX_SQL} SELECT vendor_key, count(*) AS n, {MONEY} AS total, min(txn_date) AS first_date, max(txn_date) AS last_date, count(DISTINCT amount) AS n_amounts, count(DISTINCT officer_id) AS n_officers, count(*) FILTER (amount % 1000 = 0) AS n_round FROM tx GROUP BY 1",
    ),
    "vendor_top_officers": (
        lambda s, d: explore.top_totals(line_items(s, d), "officer_id", 3),
        f"WITH {TX_SQL}, c AS (SELECT vendor_key, officer_id, count(*) AS n, {MONEY} AS total FROM tx GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY vendor_key ORDER BY total DESC, officer_id NULLS LAST) AS rank FROM c QUALIFY rank <= 3",
    ),
    "recurring_billing": (
        lambda s, d: explore.recurring_billing(line_items(s, d).withColumn("amount", F.col("quantity"))),
        f"WITH {TX_SQL} SELECT vendor_key, quantity AS amount, count(DISTINCT date_trunc('month', txn_date)) AS n_months, count(*) AS n FROM tx GROUP BY 1, 2 HAVING count(DISTINCT date_trunc('month', txn_date)) >= 6",
    ),
    "recurring_top": (
        lambda s, d: explore.recurring_top(line_items(s, d).withColumn("amount", F.col("quantity"))).select("vendor_key", "amount", "n_months", "rank"),
        f"WITH {TX_SQL}, r AS (SELECT vendor_key, quantity AS amount, count(DISTINCT date_trunc('month', txn_date)) AS n_months FROM tx GROUP BY 1, 2 HAVING count(DISTINCT date_trunc('month', txn_date)) >= 6) SELECT *, row_number() OVER (PARTITION BY vendor_key ORDER BY n_months DESC, amount)::INT AS rank FROM r QUALIFY rank <= 3",
    ),
    "benford_vendor": (
        lambda s, d: explore.benford_vendor(line_items(s, d), "000000001 supplier").select("digit", *[F.round(c, 9).alias(c) for c in ("observed", "peers", "benford")]),
        f"""WITH {TX_SQL}, a AS (SELECT DISTINCT amount FROM tx WHERE vendor_key = '000000001 supplier' AND amount > 0), p AS (SELECT DISTINCT amount FROM tx WHERE amount > 0 AND item_category IN (SELECT DISTINCT item_category FROM tx WHERE vendor_key = '000000001 supplier')), d AS (SELECT unnest(range(1, 10))::INT AS digit)
SELECT digit, round((SELECT count(*) FROM a WHERE {DIGIT} = d.digit) / (SELECT count(*) FROM a), 9) AS observed, round((SELECT count(*) FROM p WHERE {DIGIT} = d.digit) / (SELECT count(*) FROM p), 9) AS peers, round(log10(1 + 1.0::DOUBLE / digit), 9) AS benford FROM d WHERE (SELECT count(*) FROM a) >= 30""",
    ),
    "recent_rows": (
        lambda s, d: explore.recent(line_items(s, d), 3).select("row_id", "txn_date"),
        f"WITH {TX_SQL} SELECT row_id, txn_date FROM tx WHERE txn_date > (SELECT max(txn_date) FROM tx) - INTERVAL 3 MONTH",
    ),
    "rows_by_id": (
        lambda s, d: explore.by_ids(line_items(s, d), baseline.inflation(line_items(s, d)).select("row_id")).select("row_id", "vendor_key", "amount"),
        f"WITH {TX_SQL}, m AS (SELECT item_category, avg(unit_price) AS p FROM tx GROUP BY 1) SELECT row_id, vendor_key, amount FROM tx JOIN m USING (item_category) WHERE unit_price > 2 * p",
    ),
    "calculator": (
        lambda s, d: s.createDataFrame([(e, calculator.evaluate(e)) for e in CALCULATIONS], "expression string, result double"),
        "SELECT * FROM (VALUES ('1 + 2 * 3', 7.0::DOUBLE), ('-(2,500 - ₹500) / 8', -250.0), ('2 ** 2 ** 2', 16.0), ('7 % 4 + .5', 3.5), ('-7 % 4', 1.0), ('-2 ** 2', -4.0), ('1e3 * 2', 2000.0)) v(expression, result)",
    ),
    "tx_search_page": (
        lambda s, d: explore.page(explore.search(line_items(s, d), words="widget", least=1000, most=60000), [F.desc("amount"), F.asc("row_id")], 10, 25).select("row_id", "vendor_name", "item_desc", "amount"),
        f"WITH {TX_SQL} SELECT row_id, vendor_name, item_desc, amount FROM tx WHERE concat_ws('~', vendor_name, invoice_no, officer_id, item_desc, item_category) ILIKE '%widget%' AND amount BETWEEN 1000 AND 60000 ORDER BY amount DESC, row_id LIMIT 25 OFFSET 10",
    ),
    "kpi_metrics": (lambda s, d: explore.totals(line_items(s, d)), f"WITH {TX_SQL} SELECT count(*) AS n, {MONEY} AS total, min(txn_date) AS first_date, max(txn_date) AS last_date, count(DISTINCT vendor_key) AS n_vendors FROM tx"),
    "invoice_core_numbers": (
        lambda s, d: line_items(s, d).select("row_id", F.array_join(F.transform(text.core_numbers(F.col("invoice_no"), F.col("txn_date")), lambda x: x.cast("string")), ",").alias("core")),
        f"WITH {TX_SQL} SELECT row_id, CASE WHEN list_contains([year(txn_date) - 1, year(txn_date), year(txn_date) + 1, (year(txn_date) - 1) % 100, year(txn_date) % 100, (year(txn_date) + 1) % 100], CAST(substr(invoice_no, 5) AS BIGINT)) THEN '' ELSE CAST(CAST(substr(invoice_no, 5) AS BIGINT) AS VARCHAR) END AS core FROM tx",
    ),
    "indian_money": (
        lambda s, d: orders(s, d).select("row_id", text.indian_money(F.col("amount")).alias("money")),
        f"WITH {TXO_SQL}, t AS (SELECT row_id, printf('%.2f', amount) AS x FROM txo), p AS (SELECT row_id, split_part(x, '.', 1) AS w, split_part(x, '.', 2) AS r FROM t) SELECT row_id, '₹' || CASE WHEN length(w) > 5 THEN w[1:length(w) - 5] || ',' || w[length(w) - 4:length(w) - 3] || ',' || w[length(w) - 2:] WHEN length(w) > 3 THEN w[1:length(w) - 3] || ',' || w[length(w) - 2:] ELSE w END || '.' || r AS money FROM p",
    ),
    "average_precision": (
        lambda s, d: evaluate.average_precision(table(s, d, "events").select(F.floor("value").alias("score"), (F.col("event_type") == "error").alias("hit")), 1000),
        "WITH g AS (SELECT floor(value) AS score, sum((event_type = 'error')::INT) AS tp, count(*) AS n FROM events GROUP BY 1), r AS (SELECT tp, sum(tp) OVER w AS tps, sum(n) OVER w AS ns FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(tps / ns * tp / 1000), 9) AS ap FROM r",
    ),
    "row_metrics": (
        lambda s, d: evaluate.row_metrics(orders(s, d).where("amount >= 225000 and amount < 250000"), orders(s, d).where("amount > 200000 and officer_id in ('1-URGENT', '2-HIGH')")),
        "WITH f AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 225000 AND o_totalprice < 250000), p AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')), c AS (SELECT count(*) FILTER (f.k IS NOT NULL AND p.k IS NOT NULL) AS tp, count(*) FILTER (p.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM f FULL JOIN p ON f.k = p.k) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c",
    ),
    "wilson_by_group": (
        quality_by_source,
        "WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k, 1.96::DOUBLE AS z FROM labels JOIN documents USING (doc_id) GROUP BY 1), q AS (SELECT *, k / n AS p FROM c) SELECT source, n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM q",
    ),
    "majority_verdict": (
        lambda s, d: evaluate.majority(votes(s, d)),
        "WITH c AS (SELECT user_id AS case_id, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS most FROM c) SELECT case_id, CASE WHEN count(*) > 1 THEN 'unclear' ELSE min(v) END AS verdict, max(n) AS votes FROM m WHERE n = most GROUP BY 1",
    ),
    "latest_per_key": (
        lambda s, d: store.latest(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type", "value"),
        "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    ),
    "case_upsert": (
        lambda s, d: store.upsert(table(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_acctbal"), table(s, d, "supplier").where("s_nationkey < 20").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal")), "s_suppkey", ["s_name"]),
        "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE upper(s_name) END AS s_name, CASE WHEN s_nationkey < 20 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_acctbal > 0 OR s_nationkey < 20",
    ),
    "seed_spread": (
        lambda s, d: evaluate.spread(df=table(s, d, "supplier"), by=["s_nationkey"], column="s_acctbal").select("s_nationkey", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")),
        "SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 6) AS sd FROM supplier GROUP BY 1",
    ),
    "bm25_topk": (bm25, f"WITH {BM25_CTE} SELECT doc_id, round(2 * pa + pb + pc + pd, 9) AS score FROM p WHERE a + b + c + d > 0 ORDER BY 2 DESC, 1 LIMIT 20"),
    "cosine_topk": (
        cosine,
        "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "bm25_indexed": (bm25_indexed, f"WITH {BM25_CTE} SELECT doc_id, round(2 * pa + pb + pc + pd, 9) AS score FROM p WHERE a + b + c + d > 0 ORDER BY 2 DESC, 1 LIMIT 20"),
    "cosine_indexed": (
        cosine_indexed,
        "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "rrf_fuse": (
        fused,
        f"WITH {BM25_CTE}, x AS (SELECT doc_id, row_number() OVER (ORDER BY round(pa + pb, 9) DESC, doc_id) AS k FROM p WHERE a + b > 0), y AS (SELECT doc_id, row_number() OVER (ORDER BY round(pc + pd, 9) DESC, doc_id) AS k FROM p WHERE c + d > 0), z AS (SELECT * FROM x WHERE k <= 5 UNION ALL SELECT * FROM y WHERE k <= 5) SELECT doc_id AS id, round(sum(1 / (60 + k)), 12) AS score FROM z GROUP BY 1",
    ),
    "sql_guard": ((lambda s, d: (line_items(s, d).createOrReplaceTempView("audit_transactions"), explore.guarded(s, "WITH big AS (SELECT officer_id, amount FROM audit_transactions WHERE amount > 50000) SELECT officer_id, count(*) AS n FROM big GROUP BY officer_id"))[1]), f"WITH {TX_SQL} SELECT officer_id, count(*) AS n FROM tx WHERE amount > 50000 GROUP BY 1"),
}


def _all() -> dict[str, tuple[Query, str | None]]:
    out = dict(_ENTRIES)
    for module in (detection, intake, scoring, review, reports, streams):
        if clash := set(out) & set(module.ENTRIES):
            raise ValueError(f"two queries are named {sorted(clash)}")
        out |= module.ENTRIES
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
