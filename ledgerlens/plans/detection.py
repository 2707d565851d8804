"""Queries of the detectors and their cases, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.names import identity_name, name_similarity, normalize_vendor
from ..operators import bands, baseline, cases, detection, duplicates, explore, graph, linkage, prices, runs, vendors
from ..sources.adapter import TX_SQL, TXO_SQL, line_items, orders, table
from ..sources.scratch import discard, written

LOOSE = Thresholds(price_z=2.0)
#: Split runs of the provided tables score lower than real ones do.
EASY = Thresholds(split_score=0.6)


def joined(c: str = "row_ids") -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias("row_ids")


def shown(found: DataFrame) -> DataFrame:
    """The columns of cases that are compared."""
    return found.select("case_id", "anomaly_type", "detector", joined(), F.round("detector_score", 4).alias("detector_score"), F.round("amount_at_risk", 2).alias("amount_at_risk"), "severity_prelim", "band", "vendor_key")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the band join needs of the view, stored."""
    return written(line_items(spark, sf_dir).select("row_id", "amount", "txn_date"), "dated")


def twice(spark: SparkSession, sf_dir: str, tx: DataFrame | None = None) -> DataFrame:
    """Every line item (tx, where the view is stored), and each booked again three days later with its invoice number in another case and blanks around it."""
    tx = line_items(spark, sf_dir) if tx is None else tx
    again = {"row_id": F.col("row_id") + F.lit(1 << 60), "invoice_no": F.concat(F.lit("  "), F.lower("invoice_no"), F.lit(" ")), "txn_date": F.date_add("txn_date", 3)}
    both = tx.withColumn("_again", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumns({k: F.when(F.col("_again"), v).otherwise(F.col(k)) for k, v in again.items()}).drop("_again")


def exact_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of what is booked twice. The view is joined once and stored with the columns that are read."""
    once = written(line_items(spark, sf_dir).select("row_id", "vendor_key", "invoice_no", "amount", "txn_date"), "booked")
    tx = twice(spark, sf_dir, once)
    found = duplicates.duplicate_cases(tx, duplicates.exact_edges(tx).select("a", "b", F.lit("exact").alias("stage"), F.lit(1.0).alias("probability")))
    discard(once)  # groups have stored what they need of it
    return shown(found)


TWICE_SQL = """tw AS (SELECT * FROM tx UNION ALL BY NAME
  SELECT * REPLACE (row_id + (1::BIGINT << 60) AS row_id, '  ' || lower(invoice_no) || ' ' AS invoice_no, (txn_date + 3)::DATE AS txn_date) FROM tx)"""

SEVERITY = "round(100 * {0} * least(ln(1 + greatest({1}, 0)) / ln(1 + 1e7), 1.0), 2)"
BAND = "CASE WHEN severity_prelim >= 66 THEN 'high' WHEN severity_prelim >= 33 THEN 'medium' ELSE 'low' END AS band"


def case_sql(detector: str, kind: str, source: str) -> str:
    """Cases from a relation with row_ids (ordered text), score, at_risk, vendor_key."""
    digest = f"sha1(unhex('{cases.NAMESPACE}') || encode('{detector}|{kind}|' || row_ids))"
    return f"""SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS case_id,
  '{kind}' AS anomaly_type, '{detector}' AS detector, row_ids, round(score, 4) AS detector_score, round(at_risk, 2) AS amount_at_risk, severity_prelim, {BAND}, vendor_key
  FROM (SELECT *, {digest} AS h, {SEVERITY.format("score", "at_risk")} AS severity_prelim FROM {source})"""


# ---------------------------------------------------------------- duplicates

CLOSE = "abs(a.amount - b.amount) < 0.005 * greatest(a.amount, b.amount) AND abs(date_diff('day', a.txn_date, b.txn_date)) BETWEEN {0} AND {1}"


def pairs_sql(low: int, high: int, name: str = "pr", view: str = "tx") -> str:
    """Pairs of a band, by buckets of amount and date with their neighbours."""
    return f"""x{name} AS (SELECT *, floor(ln(amount) / -ln(1 - 0.005)) AS k, floor(date_diff('day', DATE '1970-01-01', txn_date) / {high + 1}) AS q FROM {view} WHERE amount > 0),
y{name} AS (SELECT x{name}.* REPLACE (k + dk AS k, q + dq AS q) FROM x{name}, (VALUES (-1), (0), (1)) v(dk), (VALUES (-1), (0), (1)) u(dq)),
{name} AS (SELECT a.row_id AS a_row_id, b.row_id AS b_row_id, a.vendor_name AS an, b.vendor_name AS bn, a.vendor_key AS ak, b.vendor_key AS bk, a.amount AS a_amount, b.amount AS b_amount, a.officer_id AS ao, b.officer_id AS bo,
  a.item_category AS ac, b.item_category AS bc, a.quantity AS aq, b.quantity AS bq, a.invoice_no AS ai, b.invoice_no AS bi, a.txn_date AS ad, b.txn_date AS bd, abs(date_diff('day', a.txn_date, b.txn_date)) AS gap
  FROM x{name} a JOIN y{name} b ON a.k = b.k AND a.q = b.q AND a.row_id < b.row_id WHERE {CLOSE.format(low, high)})"""


#: Indel similarity of two texts by the rows of the table of longest common subsequences.
LCS = """list_extract(list_reduce(string_split({0}, ''), lambda r, c: list_reduce(range(1, length({1}) + 1),
    lambda n, j: list_append(n, CASE WHEN substr({1}, j, 1) = c THEN r[j] + 1 ELSE greatest(r[j + 1], n[j]) END), [0::BIGINT]), list_transform(range(length({1}) + 1), lambda z: 0::BIGINT)), -1)"""
WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def names_sql(pairs: str, name: str) -> str:
    """Name similarity of a band's distinct name pairs; the names hold no legal forms."""
    same = "200.0 * " + LCS + " / (length({0}) + length({1}))"
    return f"""n{name} AS (SELECT an, bn, array_to_string({WORDS.format("an")}, ' ') AS ia, array_to_string({WORDS.format("bn")}, ' ') AS ib,
  array_to_string(list_sort({WORDS.format("an")}), ' ') AS sa, array_to_string(list_sort({WORDS.format("bn")}), ' ') AS sb FROM (SELECT DISTINCT an, bn FROM {pairs})),
s{name} AS (SELECT an, bn, greatest({same.format("ia", "ib")}, {same.format("sa", "sb")}) AS sim FROM n{name})"""


def core_sql(invoice: str, day: str) -> str:
    years = f"[year({day}) - 1, year({day}), year({day}) + 1, (year({day}) - 1) % 100, year({day}) % 100, (year({day}) + 1) % 100]"
    return f"list_filter(list_transform(regexp_extract_all({invoice}, '[0-9]+'), lambda g: g::BIGINT), lambda v: NOT list_contains({years}, v))"


def vectors_sql(pairs: str, name: str) -> str:
    """Comparison vectors of a band's pairs whose names are alike enough."""
    return f"""{names_sql(pairs, name)},
v{name} AS (SELECT a_row_id, b_row_id, CASE WHEN sim >= 95 THEN 0 WHEN sim >= 88 THEN 1 ELSE 2 END AS name,
  CASE WHEN ai IS NULL OR bi IS NULL THEN 3 WHEN lower(trim(ai)) = lower(trim(bi)) THEN 0 WHEN list_has_any({core_sql("ai", "ad")}, {core_sql("bi", "bd")}) THEN 1 ELSE 2 END AS invoice,
  CASE WHEN ao = bo AND ac = bc AND aq = bq AND a_amount = b_amount THEN 0 WHEN ao = bo AND ac = bc AND aq = bq THEN 1 WHEN ao = bo OR (ac = bc AND aq = bq) THEN 2 ELSE 3 END AS context,
  CASE WHEN gap <= 3 THEN 0 WHEN gap <= 7 THEN 1 ELSE 2 END AS date_gap FROM {pairs} JOIN s{name} USING (an, bn) WHERE sim >= 80)"""


def _em_sql() -> str:
    """The model as a recursive relation of one row: prior and the level shares of duplicates, with those of others fixed by the reference."""
    fields = linkage.FIELDS
    counts = "c AS (SELECT name, invoice, context, date_gap, count(*)::DOUBLE AS n FROM vpr GROUP BY ALL), ns AS (SELECT sum(n) AS n FROM c)"
    u = []
    for f, start in fields:
        source = "vpr" if f == "date_gap" else "vrf"
        u.append("[" + ", ".join(f"(SELECT (count(*) FILTER ({f} = {i}) + 0.001 * count(*)) / (count(*) * (1 + 0.001 * {len(start)})) FROM {source})" for i in range(len(start))) + f"] AS u_{f}")
    start = ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in s) + f"] AS m_{f}" for f, s in fields)
    z = "ln(prior / (1 - prior)) + " + " + ".join(f"ln(m_{f}[c.{f} + 1]) - ln(u_{f}[c.{f} + 1])" for f, _ in fields)
    post = f"1 / (1 + exp(-greatest(-50, least(50, {z}))))"
    shares = []
    for f, s in fields:
        each = [f"sum(w) FILTER ({f} = {i})" for i in range(len(s))]
        top = [f"coalesce({e}, 0) + 50.0 * {x} + 0.001" for e, x in zip(each, s, strict=True)]
        total = f"(sum(w) + 50.0 * {sum(s)} + 0.001 * {len(s)})"
        shares.append("[" + ", ".join(f"({t}) / {total}" for t in top) + f"] AS m_{f}")
    old = ", ".join(f"any_value(m_{f}) AS o_{f}" for f, _ in fields)
    moved = " + ".join(["abs(prior - o_prior)"])
    moved += " + greatest(" + ", ".join(f"list_max(list_transform(list_zip(m_{f}, o_{f}), lambda p: abs(p[1] - p[2])))" for f, _ in fields) + ")"
    keep = ", ".join(f"m_{f}" for f, _ in fields)
    return f"""{counts}, us AS (SELECT {", ".join(u)}),
em AS (SELECT 0 AS step, 0.1::DOUBLE AS prior, {start}, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step, prior, {keep}, {moved} AS moved FROM (
    SELECT any_value(step) + 1 AS step, least(1 - 1e-4, greatest(1e-4, (sum(w) + 2.0) / (any_value(total) + 40.0))) AS prior, {", ".join(shares)}, any_value(prior) AS o_prior, {old}
    FROM (SELECT em.*, c.name, c.invoice, c.context, c.date_gap, ns.n AS total, c.n * ({post}) AS w FROM em, us, ns, c WHERE em.step < 200 AND em.moved >= 1e-6)
    HAVING count(*) > 0)),
last AS (SELECT * FROM em ORDER BY step DESC LIMIT 1),
post AS (SELECT c.name, c.invoice, c.context, c.date_gap, {post} AS posterior FROM c, last, us)"""


MODEL_SQL = f"{TX_SQL}, {pairs_sql(0, 14)}, {pairs_sql(30, 180, 'rf')}, {vectors_sql('pr', 'pr')}, {vectors_sql('rf', 'rf')}, {_em_sql()}"
EDGES_SQL = """ex AS (SELECT first_value(row_id) OVER w AS a, row_id AS b FROM {0} WHERE invoice_no IS NOT NULL WINDOW w AS (PARTITION BY vendor_key, amount, lower(trim(invoice_no)) ORDER BY row_id)), ed AS (SELECT * FROM ex WHERE a <> b)"""
#: Groups of edges ed (a, b, probability): each id with the least id that it reaches.
GROUPS_SQL = """un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), rc AS (SELECT a AS id, a AS to_ FROM un UNION SELECT rc.id, un.b FROM rc JOIN un ON rc.to_ = un.a),
gr AS (SELECT id, min(to_) AS root FROM rc GROUP BY 1)"""


def group_cases_sql(view: str) -> str:
    return f"""gm AS (SELECT root, id, amount, vendor_key, row_number() OVER (PARTITION BY root ORDER BY txn_date, id) AS k FROM gr JOIN {view} ON row_id = id),
gs AS (SELECT root, max(probability) AS score FROM ed JOIN gr ON id = a GROUP BY 1),
gc AS (SELECT array_to_string(list_sort(list(id)), ',') AS row_ids, max(score) AS score, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (k > 1), 0) AS DOUBLE) AS at_risk, max(vendor_key) FILTER (k = 1) AS vendor_key
  FROM gm JOIN gs USING (root) GROUP BY gm.root)"""


def _model_sql() -> str:
    """m, u and match weight of every level."""
    rows = [f"SELECT '{f}' AS field, {i} AS level, m_{f}[{i + 1}] AS m, u_{f}[{i + 1}] AS u FROM last, us" for f, start in linkage.FIELDS for i in range(len(start))]
    return f"WITH RECURSIVE {MODEL_SQL}, ml AS ({' UNION ALL '.join(rows)}) SELECT field, level, round(m, 6) AS m, round(u, 9) AS u, round(log2(m / u), 1) AS match_weight FROM ml"


def same_vendor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(line_items(spark, sf_dir).select("row_id", "amount", "txn_date", "vendor_key"), "dated")
    return bands.amount_pairs(rows, same=("vendor_key",)).select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))


# ---------------------------------------------------------------- split runs

RUNS_SQL = f"""{TX_SQL}, p AS (SELECT *, CAST(amount AS DECIMAL(18,2)) AS am, row_number() OVER w AS i, sum(CAST(amount AS DECIMAL(18,2))) OVER w AS upto
  FROM tx WHERE amount < 250000 WINDOW w AS (PARTITION BY vendor_key, officer_id ORDER BY txn_date, row_id ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT e.vendor_key, e.officer_id, e.i AS e, max(s.i) AS s FROM p e JOIN p s ON e.vendor_key = s.vendor_key AND e.officer_id IS NOT DISTINCT FROM s.officer_id AND s.i <= e.i
  AND s.txn_date >= e.txn_date - 14 AND e.upto - s.upto + s.am >= 250000 GROUP BY 1, 2, 3),
ch AS (SELECT vendor_key, officer_id, arg_min(s, e) AS s, min(e) AS e FROM ends GROUP BY 1, 2
  UNION ALL SELECT ch.vendor_key, ch.officer_id, n.s, n.e FROM ch, LATERAL (SELECT arg_min(x.s, x.e) AS s, min(x.e) AS e FROM ends x WHERE x.vendor_key = ch.vendor_key AND x.officer_id IS NOT DISTINCT FROM ch.officer_id AND x.s > ch.e) n WHERE n.e IS NOT NULL),
r AS (SELECT ch.vendor_key, ch.officer_id, ch.e, list(p.row_id ORDER BY p.i) AS ids, CAST(sum(am) AS DOUBLE) AS total, min(txn_date) AS first_date, max(txn_date) AS last_date, count(*) AS n_parts
  FROM ch JOIN p ON p.vendor_key = ch.vendor_key AND p.officer_id IS NOT DISTINCT FROM ch.officer_id AND p.i BETWEEN ch.s AND ch.e GROUP BY 1, 2, 3)"""
SCORED_SQL = f"""{RUNS_SQL}, it AS (SELECT vendor_key, officer_id, e, max(n) AS top FROM (SELECT ch.vendor_key, ch.officer_id, ch.e, coalesce(item_category, item_desc) AS v, count(*) AS n FROM ch JOIN p ON p.vendor_key = ch.vendor_key AND p.officer_id IS NOT DISTINCT FROM ch.officer_id AND p.i BETWEEN ch.s AND ch.e GROUP BY ALL) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
rt AS (SELECT vendor_key, officer_id, e, max(n) AS top FROM (SELECT ch.vendor_key, ch.officer_id, ch.e, round(unit_price, 2) AS v, count(*) AS n FROM ch JOIN p ON p.vendor_key = ch.vendor_key AND p.officer_id IS NOT DISTINCT FROM ch.officer_id AND p.i BETWEEN ch.s AND ch.e GROUP BY ALL) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
sc AS (SELECT r.vendor_key, r.officer_id, r.ids, r.total, r.first_date, r.last_date, r.n_parts, date_diff('day', r.first_date, r.last_date) AS span_days,
  CASE WHEN span_days <= 3 THEN 3 WHEN span_days <= 7 THEN 7 ELSE 14 END AS window_days, CASE WHEN span_days <= 3 THEN 1.0 WHEN span_days <= 7 THEN 0.75 ELSE 0.5 END::DOUBLE AS "window",
  round(coalesce(it.top / n_parts, 0.5), 3) AS homogeneity, round(coalesce(rt.top / n_parts, 0.5), 3) AS single_rate, CASE WHEN n_parts BETWEEN 3 AND 6 THEN 1.0 WHEN n_parts = 2 THEN 0.6 ELSE 0.7 END::DOUBLE AS parts
  FROM r LEFT JOIN it USING (vendor_key, officer_id, e) LEFT JOIN rt USING (vendor_key, officer_id, e)),
sr AS (SELECT *, round(0.25::DECIMAL(4,2) * ("window"::DECIMAL(6,3) + homogeneity::DECIMAL(6,3) + single_rate::DECIMAL(6,3) + parts::DECIMAL(6,3)), 4)::DOUBLE AS score FROM sc)"""

# ---------------------------------------------------------------- prices

PRICES_SQL = f"""{TX_SQL}, e AS (SELECT *, ln(unit_price) AS lp FROM tx WHERE unit_price > 0 AND quantity > 0 AND item_category IS NOT NULL),
m AS (SELECT item_category, median(lp) AS md, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT e.*, md, lp - md AS rel, ln(quantity) AS lq, date_diff('day', min(txn_date) OVER (), txn_date)::DOUBLE AS t FROM e JOIN m USING (item_category)),
av AS (SELECT avg(lq) AS ml, avg(t) AS mt, avg(rel) AS mr FROM s),
k AS (SELECT sum((lq - ml) ** 2) AS a, sum((lq - ml) * (t - mt)) AS b, sum((t - mt) ** 2) AS d, sum((lq - ml) * (rel - mr)) AS p, sum((t - mt) * (rel - mr)) AS q FROM s, av),
bt AS (SELECT (p * d - q * b) / (a * d - b * b) AS bl, (a * q - b * p) / (a * d - b * b) AS bd FROM k),
rs AS (SELECT s.*, bl, bd, rel - mr - bl * (lq - ml) - bd * (t - mt) AS res FROM s, av, bt),
c1 AS (SELECT median(res) AS c FROM rs), c2 AS (SELECT greatest(1.4826 * median(abs(res - c)), 0.02) AS sp FROM rs, c1),
z AS (SELECT rs.*, (res - c) / sp AS z, exp(md + bl * lq + bd * t) AS expected_price FROM rs, c1, c2)"""

# ---------------------------------------------------------------- vendors

DIGIT = "CAST(floor(amount / pow(10.0, floor(log10(amount)))) AS INTEGER)"
AM = """am AS (SELECT vendor_key, amount, arg_min(coalesce(item_category, '(uncategorised)'), row_id) AS item_category FROM tx WHERE amount > 0 GROUP BY 1, 2)"""


def share_sql(name: str, rows: str) -> str:
    """Vendors' shares of hits against their categories' rates, with the tail by the regularised incomplete sum in logarithms."""
    return f"""rr{name} AS ({rows}), ra{name} AS (SELECT item_category, avg(hit) AS rate FROM rr{name} GROUP BY 1),
rv{name} AS (SELECT vendor_key, count(*) AS n, sum(hit)::BIGINT AS k, avg(CASE WHEN rate = 0 THEN (SELECT avg(hit) FROM rr{name}) ELSE rate END) AS rate FROM rr{name} JOIN ra{name} USING (item_category) GROUP BY 1),
t{name} AS (SELECT vendor_key, n, k, rate, CASE WHEN k = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(rate) + (n - i) * ln(1 - rate))))) END AS p_value,
  k / n >= 2 * rate AS material FROM rv{name} WHERE n >= 20 AND rate > 0 AND rate < 1)"""


VENDORS_SQL = f"""{TX_SQL}, {AM}, cd AS (SELECT item_category, {DIGIT} AS digit, count(*) AS n FROM am GROUP BY 1, 2), ds AS (SELECT item_category, digit, n / sum(n) OVER (PARTITION BY item_category) AS share FROM cd),
vn AS (SELECT vendor_key, count(*) AS n FROM am GROUP BY 1 HAVING count(*) >= 30 AND max(amount) / min(amount) >= 30),
pe AS (SELECT am.vendor_key, d.digit, sum(coalesce(ds.share, 0)) / max(vn.n) AS peer, max(vn.n) AS n FROM am JOIN vn USING (vendor_key), (SELECT unnest(range(1, 10)) AS digit) d LEFT JOIN ds ON ds.item_category = am.item_category AND ds.digit = d.digit GROUP BY 1, 2),
ob AS (SELECT vendor_key, {DIGIT} AS digit, count(*) AS seen FROM am GROUP BY 1, 2),
fd AS (SELECT vendor_key, max(n) AS n, sum((coalesce(seen, 0) - p * n) ** 2 / (p * n)) AS chi2, sum(abs(coalesce(seen, 0) / n - peer)) / 9 AS mad FROM (SELECT pe.*, CASE WHEN peer > 0 THEN peer ELSE 1e-6 END AS p FROM pe) LEFT JOIN ob USING (vendor_key, digit) GROUP BY 1),
tfd AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2 + (chi2 / 2) ** 3 / 6) AS p_value FROM fd WHERE mad >= 0.015),
{share_sql("rn", "SELECT vendor_key, item_category, (amount % 1000 = 0)::INT AS hit FROM am")},
{share_sql("en", "SELECT vendor_key, coalesce(item_category, '(uncategorised)') AS item_category, (month(txn_date) = 3 OR day(txn_date) > day(last_day(txn_date)) - 4)::INT AS hit FROM tx WHERE amount > 0")},
ev AS (SELECT vendor_key, p_value FROM tfd UNION ALL SELECT vendor_key, p_value FROM trn WHERE material UNION ALL SELECT vendor_key, p_value FROM ten WHERE material),
fi AS (SELECT vendor_key, count(*) AS k, -2 * sum(ln(greatest(p_value, 1e-300))) AS x FROM ev GROUP BY 1),
cp AS (SELECT vendor_key, exp(-x / 2) * (1 + CASE WHEN k > 1 THEN x / 2 ELSE 0 END + CASE WHEN k > 2 THEN (x / 2) ** 2 / 2 ELSE 0 END) AS combined_p FROM fi),
bh AS (SELECT *, row_number() OVER (ORDER BY combined_p, vendor_key) AS rank, count(*) OVER () AS n FROM cp),
fl AS (SELECT vendor_key, combined_p, coalesce(max(combined_p) FILTER (combined_p <= 0.05 * rank / n) OVER (), 0) AS cutoff FROM bh),
fg AS (SELECT *, combined_p <= cutoff AS flagged, least(1.0, -log10(greatest(combined_p, 1e-300)) / 20) AS score FROM fl)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.flags(line_items(spark, sf_dir)).select("vendor_key", F.format_string("%.6e", "combined_p").alias("combined_p"), "flagged", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- names

FORMS = (("M / s ", " Private Limited"), ("Messrs. ", ""), ("The ", " Co."), ("M/S. ", " Co op"), ("", " Coop Limitd"), ("", " Tradres and Enterprises"))


def disguised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name in all forms of a firm's name."""
    forms = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(FORMS)]))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", forms.alias("f")).select("c_custkey", "c_name", "f.form", F.concat("f.a", F.upper("c_name"), "f.b").alias("vendor_name"))


def disguised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = disguised(spark, sf_dir)
    return rows.select("c_custkey", "form", normalize_vendor("vendor_name").alias("key"), identity_name("vendor_name").alias("identity"), F.round(name_similarity("vendor_name", "c_name"), 6).alias("similarity"))


def _names_sql() -> str:
    number = "substr(c_name, 10)"
    keys = {3: f"'cooperative customer'", 4: f"'cooperative customer'"}
    identity = {3: " || ' cooperative'", 4: " || ' cooperative'", 5: " || ' tradres enterprises'"}
    parts = []
    for i in range(len(FORMS)):
        key = f"{number} || ' ' || {keys.get(i, chr(39) + 'customer' + chr(39))}"
        own = f"'customer ' || {number}{identity.get(i, '')}"
        parts.append(f"SELECT c_custkey, {i} AS form, {key} AS key, {own} AS identity, round(200.0 * 18 / (18 + length({own})), 6) AS similarity FROM customer")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- similar rows

def _near_sql(name: str, group: str, value: str, gap: str, k: int, more: str, most: str) -> str:
    """The k nearest of a group: of each row's own value the first k + 1, and the 2 k rows beside it on either side."""
    sides = "UNION ALL".join(
        f" SELECT row_id, unnest([lead({{'v': {value}, 'id': row_id}}, i) OVER w FOR i IN range(1, {2 * k})]) AS x FROM {name} WINDOW w AS (PARTITION BY {group} ORDER BY {value} {order}, row_id) " for order in ("ASC", "DESC")
    )
    return sides + gap + more + most


SIMILAR_SQL = f"""WITH {TX_SQL}, st AS (SELECT row_id, vendor_key, txn_date, floor(date_diff('day', DATE '1970-01-01', txn_date) / 90) AS b FROM tx),
near AS (SELECT s.row_id, o.row_id AS near_id, abs(date_diff('day', s.txn_date, o.txn_date))::DOUBLE AS gap FROM st s JOIN (SELECT st.* REPLACE (b + d AS b) FROM st, (VALUES (-1), (0), (1)) v(d)) o ON s.vendor_key = o.vendor_key AND s.b = o.b AND s.row_id <> o.row_id WHERE abs(date_diff('day', s.txn_date, o.txn_date)) <= 90),
pc AS (SELECT row_id, item_category, unit_price, dense_rank() OVER (PARTITION BY item_category ORDER BY unit_price) AS g FROM tx WHERE item_category IS NOT NULL AND unit_price IS NOT NULL),
ti AS (SELECT *, row_number() OVER (PARTITION BY item_category, g ORDER BY row_id) AS o FROM pc),
co AS (SELECT s.row_id, o.row_id AS near_id, abs(o.unit_price - s.unit_price) AS gap FROM pc s JOIN ti o ON s.item_category = o.item_category AND o.g BETWEEN s.g - 3 AND s.g + 3 AND o.o <= 4 AND s.row_id <> o.row_id)
SELECT 'same_supplier' AS leg, row_id, row_number() OVER (PARTITION BY row_id ORDER BY gap, near_id)::INT AS rank, near_id, gap FROM near QUALIFY rank <= 3
UNION ALL SELECT 'same_commodity', row_id, row_number() OVER (PARTITION BY row_id ORDER BY gap, near_id)::INT AS rank, near_id, gap FROM co QUALIFY rank <= 3"""

ENTRIES = {
    "case_ids": (lambda s, d: shown(cases.build(baseline.near_threshold(orders(s, d)), "baseline", "split")), f"WITH {TXO_SQL}, c AS (SELECT row_id::VARCHAR AS row_ids, 1.0::DOUBLE AS score, amount AS at_risk, vendor_key FROM txo WHERE amount >= 225000 AND amount < 250000) {case_sql('baseline', 'split', 'c')}"),
    "d1_exact_edges": (lambda s, d: duplicates.exact_edges(twice(s, d)), f"WITH {TX_SQL}, {TWICE_SQL}, {EDGES_SQL.format('tw')} SELECT a, b FROM ed"),
    "d1_exact_cases": (
        exact_cases,
        f"WITH RECURSIVE {TX_SQL}, {TWICE_SQL}, {EDGES_SQL.format('tw').replace('ed AS (SELECT *', 'ed AS (SELECT *, 1.0::DOUBLE AS probability')}, {GROUPS_SQL}, {group_cases_sql('tw')} {case_sql('d1', 'duplicate', 'gc')}",
    ),
    "d1_blocked_pairs": (lambda s, d: bands.amount_pairs(dated(s, d)).select("a_row_id", "b_row_id"), f"WITH {TX_SQL}, {pairs_sql(0, 14)} SELECT a_row_id, b_row_id FROM pr"),
    "d1_reference_pairs": (lambda s, d: bands.amount_pairs(dated(s, d), days=(30, 180)).select("a_row_id", "b_row_id"), f"WITH {TX_SQL}, {pairs_sql(30, 180)} SELECT a_row_id, b_row_id FROM pr"),
    "d1_levels_histogram": (
        lambda s, d: linkage.levels(bands.band(linkage.comparable(line_items(s, d), named=False))).groupBy("context", "date_gap", "invoice").agg(F.count("*").alias("n")),
        f"""WITH {TX_SQL}, {pairs_sql(0, 14)} SELECT CASE WHEN ao = bo AND ac = bc AND aq = bq AND a_amount = b_amount THEN 0 WHEN ao = bo AND ac = bc AND aq = bq THEN 1 WHEN ao = bo OR (ac = bc AND aq = bq) THEN 2 ELSE 3 END AS context,
  CASE WHEN gap <= 3 THEN 0 WHEN gap <= 7 THEN 1 ELSE 2 END AS date_gap, CASE WHEN lower(trim(ai)) = lower(trim(bi)) THEN 0 WHEN list_has_any({core_sql("ai", "ad")}, {core_sql("bi", "bd")}) THEN 1 ELSE 2 END AS invoice, count(*) AS n FROM pr GROUP BY 1, 2, 3""",
    ),
    "d1_components": (lambda s, d: graph.components(same_vendor_edges(s, d)), f"WITH RECURSIVE {TX_SQL}, {pairs_sql(0, 14)}, ed AS (SELECT a_row_id AS a, b_row_id AS b FROM pr WHERE ak = bk), {GROUPS_SQL} SELECT id, root FROM gr"),
    "d1_posteriors": (
        lambda s, d: linkage.linked(line_items(s, d)).select("a_row_id", "b_row_id", "name", "invoice", "context", "date_gap", F.round("posterior", 6).alias("posterior")),
        f"WITH RECURSIVE {MODEL_SQL} SELECT a_row_id, b_row_id, name, invoice, context, date_gap, round(posterior, 6) AS posterior FROM vpr JOIN post USING (name, invoice, context, date_gap)",
    ),
    "d1_model": (lambda s, d: linkage.model_frame(line_items(s, d)).select("field", "level", F.round("m", 6).alias("m"), F.round("u", 9).alias("u"), F.round(F.log2(F.col("m") / F.col("u")), 1).alias("match_weight")), _model_sql()),
    "d1_cases": (
        lambda s, d: shown(duplicates.detect(line_items(s, d))),
        f"""WITH RECURSIVE {MODEL_SQL}, {EDGES_SQL.format('tx').replace('ed AS', 'e1 AS')}, ed AS (SELECT a, b, 1.0::DOUBLE AS probability FROM e1
  UNION ALL SELECT a_row_id, b_row_id, round(posterior, 4) FROM vpr JOIN post USING (name, invoice, context, date_gap) WHERE posterior >= 0.5 AND (a_row_id, b_row_id) NOT IN (SELECT (a, b) FROM e1)), {GROUPS_SQL}, {group_cases_sql('tx')} {case_sql('d1', 'duplicate', 'gc')}""",
    ),
    "d2_runs": (
        lambda s, d: runs.minimal_runs(line_items(s, d)).select("vendor_key", "officer_id", joined(), "total", "first_date", "last_date", "n_parts"),
        f"WITH RECURSIVE {RUNS_SQL} SELECT vendor_key, officer_id, array_to_string(ids, ',') AS row_ids, total, first_date, last_date, n_parts::INT AS n_parts FROM r",
    ),
    "d2_scored_runs": (
        lambda s, d: runs.scored_runs(line_items(s, d)).select("vendor_key", "officer_id", "run_id", "total", "n_parts", "span_days", "window_days", "window", "homogeneity", "single_rate", "parts", "score"),
        f'WITH RECURSIVE {SCORED_SQL} SELECT vendor_key, officer_id, ids[1] AS run_id, total, n_parts::INT AS n_parts, span_days::INT AS span_days, window_days, "window", homogeneity, single_rate, parts, score FROM sr',
    ),
    "d2_cases": (
        lambda s, d: shown(runs.detect(line_items(s, d), EASY)),
        f"WITH RECURSIVE {SCORED_SQL}, c AS (SELECT array_to_string(list_sort(ids), ',') AS row_ids, score, total AS at_risk, vendor_key FROM sr WHERE score >= 0.6) {case_sql('d2', 'split', 'c')}",
    ),
    "case_metadata": (
        lambda s, d: runs.detect(line_items(s, d), EASY).select(joined(), *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("policy_clauses", "grain", "parts", "window_days")]),
        f"WITH RECURSIVE {SCORED_SQL} SELECT array_to_string(list_sort(ids), ',') AS row_ids, CASE WHEN window_days <= 7 THEN 'SG-PP-3.2,SG-PP-3.3' ELSE 'SG-PP-3.2' END AS policy_clauses, 'supplier and officer' AS grain, n_parts::VARCHAR AS parts, window_days::VARCHAR AS window_days FROM sr WHERE score >= 0.6",
    ),
    "d3_category_stats": (
        lambda s, d: prices.category_stats(prices.eligible(line_items(s, d))).select("item_category", "n", F.round("median", 9).alias("median"), F.round("mad", 9).alias("mad")),
        f"WITH {TX_SQL}, e AS (SELECT *, ln(unit_price) AS lp FROM tx WHERE unit_price > 0 AND quantity > 0), m AS (SELECT item_category, median(lp) AS md, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 20) SELECT item_category, max(n) AS n, round(max(md), 9) AS median, round(median(abs(lp - md)), 9) AS mad FROM e JOIN m USING (item_category) GROUP BY 1",
    ),
    "d3_scores": (
        lambda s, d: prices.scores(line_items(s, d), LOOSE).select("row_id", F.round("z", 3).alias("z"), F.round("expected_price", 4).alias("expected_price"), F.round("vendor_share", 9).alias("vendor_share")),
        f"WITH {PRICES_SQL} SELECT row_id, round(z, 3) AS z, round(expected_price, 4) AS expected_price, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER (PARTITION BY item_category, vendor_key) AS DOUBLE) / CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER (PARTITION BY item_category) AS DOUBLE), 9) AS vendor_share FROM z",
    ),
    "d3_cases": (
        lambda s, d: shown(prices.detect(line_items(s, d), Thresholds(price_z=0.6))),
        f"WITH {PRICES_SQL}, c AS (SELECT row_id::VARCHAR AS row_ids, round(1 / (1 + exp(-(z - 0.6))), 4) AS score, greatest((unit_price - expected_price) * quantity, 0) AS at_risk, vendor_key FROM z WHERE z >= 0.6) {case_sql('d3', 'inflation', 'c')}",
    ),
    "d4_digit_share": (
        lambda s, d: vendors.digit_shares(line_items(s, d)),
        f"WITH {TX_SQL}, {AM}, c AS (SELECT item_category, {DIGIT} AS digit, count(*) AS n FROM am GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY item_category) AS share FROM c",
    ),
    "d4_first_digit": (
        lambda s, d: vendors.first_digit_test(line_items(s, d)).select("vendor_key", "n", F.round("chi2", 6).alias("chi2"), F.round("mad", 9).alias("mad"), F.round("p_value", 9).alias("p_value")),
        f"WITH {VENDORS_SQL} SELECT vendor_key, n, round(chi2, 6) AS chi2, round(mad, 9) AS mad, round(p_value, 9) AS p_value FROM tfd",
    ),
    "d4_round_numbers": (
        lambda s, d: vendors.round_number_test(line_items(s, d), Thresholds(round_unit=5)).select("vendor_key", "n", "k", F.round("rate", 9).alias("rate"), F.round("p_value", 7).alias("p_value"), "material"),
        f"WITH {VENDORS_SQL.replace('amount % 1000', 'amount % 5')} SELECT vendor_key, n, k, round(rate, 9) AS rate, round(p_value, 7) AS p_value, material FROM trn",
    ),
    "d4_period_end": (
        lambda s, d: vendors.period_end_test(line_items(s, d)).select("vendor_key", "n", "k", F.round("rate", 9).alias("rate"), F.round("p_value", 7).alias("p_value"), "material"),
        f"WITH {VENDORS_SQL} SELECT vendor_key, n, k, round(rate, 9) AS rate, round(p_value, 7) AS p_value, material FROM ten",
    ),
    "d4_flags": (flags, f"WITH {VENDORS_SQL} SELECT vendor_key, printf('%.6e', combined_p) AS combined_p, flagged, round(score, 6) AS score FROM fg"),
    "d4_roll_up": (
        lambda s, d: vendors.roll_up(line_items(s, d)).withColumn("officers", F.array_join("officers", ",")),
        f"WITH {TX_SQL}, r AS (SELECT vendor_key, count(*) AS n, count(DISTINCT amount) AS n_amounts, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, max(amount) AS largest, min(txn_date) AS first_seen, arg_min(vendor_name, row_id) AS vendor_name, array_to_string(list_sort(list(DISTINCT officer_id)), ',') AS officers FROM tx WHERE amount > 0 GROUP BY 1) SELECT *, date_diff('day', (SELECT min(txn_date) FROM tx), first_seen) > 90 AND largest >= 250000 AS new_vendor_high_value FROM r",
    ),
    "d4_cases": (
        lambda s, d: shown(vendors.detect(line_items(s, d))),
        f"WITH {VENDORS_SQL}, ro AS (SELECT vendor_key, array_to_string(list_sort(list(row_id)), ',') AS row_ids, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS at_risk FROM tx WHERE amount > 0 GROUP BY 1), c AS (SELECT row_ids, round(score, 4) AS score, at_risk, vendor_key FROM fg JOIN ro USING (vendor_key) WHERE flagged) {case_sql('d4', 'vendor_flag', 'c')}",
    ),
    "baseline_cases": (
        lambda s, d: detection.summary(detection.run_detection(line_items(s, d), ("baseline",))),
        f"""WITH {TX_SQL}, m AS (SELECT item_category, avg(unit_price) AS mp FROM tx GROUP BY 1 HAVING count(*) >= 2), c AS (
  SELECT count(*) AS n, amount * (count(*) - 1) AS r FROM tx WHERE invoice_no IS NOT NULL GROUP BY lower(trim(vendor_name)), amount, invoice_no HAVING count(*) > 1
  UNION ALL SELECT 1, amount FROM tx WHERE amount >= 225000 AND amount < 250000 UNION ALL SELECT 1, (unit_price - mp) * coalesce(quantity, 1) FROM tx JOIN m USING (item_category) WHERE unit_price > 2 * mp
  UNION ALL SELECT count(*) FILTER (amount % 1000 = 0), CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (amount % 1000 = 0) AS DOUBLE) FROM tx GROUP BY vendor_key HAVING count(*) >= 10 AND count(*) FILTER (amount % 1000 = 0) / count(*) >= 0.5)
SELECT 'baseline' AS detector, count(*) AS n_cases, sum(n)::BIGINT AS n_rows, CAST(sum(CAST(r AS DECIMAL(24,4))) AS DOUBLE) AS at_risk FROM c""",
    ),
    "clean_check": (lambda s, d: detection.clean_check(detection.run_detection(line_items(s, d))), None),
    "vendor_names": (disguised_names, _names_sql()),
    "similar_rows": (lambda s, d: explore.similar_rows(line_items(s, d), 3), SIMILAR_SQL),
}


def _clean_sql() -> str:
    """Cases and distinct rows of all four detectors at their own thresholds."""
    own = {
        "d1": ENTRIES["d1_cases"][1],
        "d2": ENTRIES["d2_cases"][1].replace("score >= 0.6", "score >= 0.85"),
        "d3": ENTRIES["d3_cases"][1].replace("z - 0.6", "z - 5.5").replace("z >= 0.6", "z >= 5.5"),
        "d4": ENTRIES["d4_cases"][1],
    }
    each = "SELECT '{0}' AS detector, count(DISTINCT case_id) AS n_cases, count(DISTINCT x) AS n_rows FROM (SELECT case_id, unnest(string_split(row_ids, ',')) AS x FROM ({1}))"
    return " UNION ALL ".join(each.format(d, sql) for d, sql in own.items())


ENTRIES["clean_check"] = (ENTRIES["clean_check"][0], _clean_sql())
