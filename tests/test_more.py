"""Operators against brute force and by their own rules: names, the SQL guard, similar rows, ranks, planting, matching, intake, tables, calculator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Thresholds
from ledgerlens.functions import calculator, text
from ledgerlens.functions.names import identity_of, key_of
from ledgerlens.functions.stats import exact_ranks
from ledgerlens.operators import baseline, detection, duplicates, evaluate, explore, graph, ingest, inject, intake, notes, policy, prices, queue, review, vendors
from ledgerlens.sources import tables

DAY = dt.date(2025, 4, 1)
FIELDS = "row_id long, vendor_name string, vendor_key string, invoice_no string, amount double, txn_date date, officer_id string, item_desc string, item_category string, quantity double, unit_price double"


def ledger(spark, n=600, seed=1, vendors_=12):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        v, q, p = r.randrange(vendors_), r.choice([1.0, 4.0, 8.0, 12.0, 40.0]), round(r.uniform(500, 9000), 2)
        rows.append((i, f"Firm {chr(65 + v)}shok Works Pvt Ltd", f"firm {v}", f"INV-{i:05d}" if r.random() < 0.9 else None, round(q * p, 2), DAY + dt.timedelta(r.randrange(400)), r.choice(["A", "B", None]), "thing", r.choice(["x", "y", None]), q, p))
    return spark.createDataFrame(rows, FIELDS)


@pytest.mark.parametrize(("name", "key", "identity"), [
    ("M / s Sharma Traders", "sharma", "sharma traders"), ("Amul Co op Society", "amul cooperative society", "amul cooperative society"), ("Amul Coop Society Ltd", "amul cooperative society", "amul cooperative society"),
    ("AMUL CO-OPERATIVE SOCIETY", "amul cooperative society", "amul cooperative society"), ("The", "", ""), ("The Company Ltd", "company ltd", "company ltd"), ("शर्मा ट्रेडर्स", "ट्रेडर्स शर्मा", "शर्मा ट्रेडर्स"), ("Messrs. Rao & Co.", "rao", "rao"),
    ("Cooperate Tools", "cooperate tools", "cooperate tools"), ("Ｆｕｌｌ Width Inc", "full width", "full width"),
])
def test_names(name, key, identity):
    assert (key_of(name), identity_of(name)) == (key, identity)


@pytest.mark.parametrize("sql", [
    "SELECT ', transactions as (' AS x FROM transactions", "WITH a AS (SELECT 1) SELECT * FROM b", "SELECT (SELECT max(x) FROM secrets) FROM audit_transactions", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 0)",
    "WITH a AS (WITH secrets AS (SELECT 1 AS x) SELECT * FROM secrets) SELECT * FROM secrets", "SELECT * FROM range(5)", "SELECT TRANSFORM(amount) USING 'cat' FROM audit_transactions", "", "SELECT * FROM a.audit_transactions", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
])
def test_guard_refuses(spark, sql):
    with pytest.raises(Exception):  # noqa: B017 - refused by the guard or by the parser
        explore.checked_sql(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM audit_transactions", "WITH a AS (SELECT * FROM audit_transactions), b AS (SELECT * FROM a) SELECT count(*) FROM a JOIN b USING (row_id);", "SELECT x.* FROM (SELECT amount FROM AUDIT_TRANSACTIONS WHERE amount > (SELECT avg(amount) FROM audit_transactions)) x ORDER BY 1 LIMIT 3", "SELECT 'from secrets' AS t FROM audit_transactions"])
def test_guard_allows(spark, sql):
    ledger(spark, 20).createOrReplaceTempView("audit_transactions")
    assert explore.guarded(spark, sql).count() > 0


def test_similar_rows_are_the_nearest(spark):
    """Many rows a day and many of one price, ties by row_id, no price, no category."""
    r = random.Random(7)
    rows = [(i, "v", f"v{r.randrange(3)}", None, 10.0, DAY + dt.timedelta(r.choice([0, 0, 0, 1, 40, 95, 190])), "o", "d", r.choice(["x", "x", None]), 1.0, r.choice([5.0, 5.0, 5.5, 7.0, None])) for i in r.sample(range(1000), 160)]
    got = {(x.leg, x.row_id, x.rank): (x.near_id, x.gap) for x in explore.similar_rows(spark.createDataFrame(rows, FIELDS), 3).collect()}
    want = {}
    for a in rows:
        near = sorted((abs((a[5] - b[5]).days), b[0]) for b in rows if b[0] != a[0] and b[2] == a[2] and abs((a[5] - b[5]).days) <= 90)[:3]
        want |= {("same_supplier", a[0], i): (k, float(d)) for i, (d, k) in enumerate(near, 1)}
        if a[8]:
            near = sorted((abs(b[10] - (a[10] or 0)), b[0]) for b in rows if b[0] != a[0] and b[8] == a[8] and b[10] is not None)[:3]
            want |= {("same_commodity", a[0], i): (k, d) for i, (d, k) in enumerate(near, 1)}
    assert got == want


def test_exact_ranks(spark):
    r = random.Random(5)
    rows = [(g, r.choice([r.random() * 100, 50.0, -3.0])) for g in "abcd" for _ in range(r.randrange(1, 400))] + [("e", 1.0), ("a", None)]
    got = {x.g: (x.n, x.median, x.p95) for x in exact_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], {"median": (0.5, "middle"), "p95": (0.95, "nearest")}, accuracy=40).collect()}
    for g in "abcde":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[round(0.95 * (len(v) - 1))])


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    label = {i: i for e in edges for i in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_duplicate_cases(spark):
    """An exact pair and a probable one join into one case; the first row is the original."""
    tx = ledger(spark, 5)
    pairs = spark.createDataFrame([(1, 2, "exact", 1.0), (2, 3, "probabilistic", 0.7), (4, 5, "probabilistic", 0.6)], "a long, b long, stage string, probability double")
    got = {tuple(x.row_ids): x for x in duplicates.duplicate_cases(tx, pairs).collect()}
    rows = {x.row_id: x for x in tx.collect()}
    assert set(got) == {(1, 2, 3), (4, 5)}
    first = min((1, 2, 3), key=lambda i: (rows[i].txn_date, i))
    assert got[1, 2, 3].amount_at_risk == pytest.approx(sum(rows[i].amount for i in (1, 2, 3) if i != first)) and got[1, 2, 3].detector_score == 1.0 and got[4, 5].detector_score == 0.6


def test_injection(spark):
    """What the planted table promises: disjoint rows, exact totals, caps, windows, truth that points at rows, and the same again."""
    tx, t = ledger(spark, 900), Thresholds(approval=60_000.0)
    plan = inject.Plan(rate=0.05, vendor_flags=2)
    table, truth, short = inject.inject(tx, plan, t)
    rows, groups = {x.row_id: x for x in table.collect()}, truth.collect()
    clean = {x.row_id: x for x in tx.collect()}
    assert len(rows) == table.count() and all(i in rows for g in groups for i in g.row_ids)
    want = plan.counts(900, 12)
    assert {k: sum(g.anomaly_type == k for g in groups) for k in want} == {k: v - short.get(k, 0) for k, v in want.items()} and want["duplicate"] == sum(g.anomaly_type == "duplicate" for g in groups)
    sources = [i for g in groups for i in g.source_row_ids]
    assert len(sources) == len({*sources})
    low, high = min(x.txn_date for x in clean.values()), max(x.txn_date for x in clean.values())
    for g in groups:
        mine = [rows[i] for i in g.row_ids]
        assert all(low <= x.txn_date <= high + dt.timedelta(2) for x in mine)
        if g.anomaly_type == "split":
            source = clean[g.source_row_ids[0]]
            assert source.row_id not in rows and 3 <= len(mine) <= 6 and sum(x.quantity for x in mine) == source.quantity
            assert round(sum(x.amount for x in mine), 2) == source.amount == g.amount_at_risk and all(0 < x.amount < 0.98 * 60_000 and x.officer_id == source.officer_id for x in mine)
            assert max(x.txn_date for x in mine) - min(x.txn_date for x in mine) <= dt.timedelta(14)
        if g.anomaly_type == "duplicate":
            source, copies = mine[0], mine[1:]
            assert not source.is_injected and copies and all(x.amount == source.amount and abs((x.txn_date - source.txn_date).days) <= 14 for x in copies)
            assert g.amount_at_risk == pytest.approx(source.amount * len(copies))
        if g.anomaly_type == "inflation":
            (x,) = mine
            assert 1.5 - 1e-3 <= x.unit_price / clean[x.row_id].unit_price < 3.0 + 1e-3 and g.amount_at_risk == pytest.approx(x.amount - clean[x.row_id].amount, abs=0.01)
        if g.anomaly_type == "vendor_flag":
            assert 35 <= len(mine) <= 60 and len({x.vendor_key for x in mine}) == 1 and g.vendor_key not in {x.vendor_key for x in clean.values()}
    untouched = {i: x for i, x in rows.items() if not x.is_injected}
    assert all(tuple(x)[:11] == tuple(clean[i]) for i, x in untouched.items())
    again, truth_again, _ = inject.inject(tx, plan, t)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect())) and sorted(map(str, truth_again.collect())) == sorted(map(str, groups))
    with pytest.raises(ValueError):
        inject.inject(table, plan, t)


def test_plan_is_checked():
    for wrong in ({"rate": 0.2}, {"split_share": 0.5}, {"duplicate_shift": 13}, {"factor": (1.0, 2.0)}, {"parts": (1, 3)}, {"vendor_rows": (10, 20)}, {"round_share": (0.5, 1.0)}):
        with pytest.raises(ValueError):
            inject.Plan(**wrong).checked()


def test_typed_matching(spark):
    """Cases match groups of their own type only, vendor flags by vendor; the better score claims first, and pooled figures are of counts."""
    cases = spark.createDataFrame([("a", "split", 0.9, [1, 2], "v"), ("b", "duplicate", 0.8, [1, 2], "v"), ("c", "vendor_flag", 0.7, [9], "w"), ("d", "vendor_flag", 0.6, [8], "w"), ("e", "split", 0.9, [2, 3], "v")], "case_id string, anomaly_type string, score double, row_ids array<long>, vendor_key string")
    truth = spark.createDataFrame([("g1", "split", [1, 2, 3], "v"), ("g2", "vendor_flag", [100], "w"), ("g3", "inflation", [5], "u")], "group_id string, anomaly_type string, rows array<long>, vendor_key string")
    assert sorted(map(tuple, evaluate.greedy(evaluate.candidate_matches(cases, truth)).collect())) == [("a", "g1"), ("c", "g2")]
    got = {(x.anomaly_type, x.granularity): x for x in evaluate.metrics(cases, truth).collect()}
    assert tuple(got["all", "case"])[2:5] == (2, 3, 1) and got["duplicate", "case"].precision == 0 and got["split", "row"].tp == 3 and got["inflation", "case"].pr_auc == 0.0
    assert got["vendor_flag", "case"].pr_auc == 1.0 and got["split", "row"].pr_auc is None


def test_detection_refuses(spark):
    with pytest.raises(KeyError):
        detection.run_detection(ledger(spark, 5), ("d7",))
    with pytest.raises(detection.PlantedDataError):
        detection.run_detection(ledger(spark, 5), planted=True)


def test_whole_detection_finds_what_is_planted(spark):
    tx, t = ledger(spark, 900, seed=4), Thresholds(approval=60_000.0)
    table, truth, _ = inject.inject(tx, inject.Plan(rate=0.03, vendor_flags=2), t)
    found = detection.run_detection(table, ("d2", "d3", "d4", "baseline"), t)
    assert {x.detector for x in found.select("detector").distinct().collect()} >= {"d2", "baseline"}
    first, second = (detection.fingerprint(detection.run_detection(table, ("d2", "d4"), t)).first() for _ in range(2))
    assert first == second and first.n_cases > 0


def test_null_categories_are_peers_of_their_own(spark):
    tx = ledger(spark, 400).withColumn("item_category", F.lit(None).cast("string"))
    assert vendors.digit_shares(tx).select("item_category").distinct().first()[0] == vendors.NO_CATEGORY and vendors.period_end_test(tx).count() == 12
    assert prices.scores(tx).count() == 0


def test_mapping_is_checked():
    base = {"vendor_name": "a", "amount": "b", "txn_date": "c"}
    assert ingest.Mapping(base).headers == ["a", "b", "c"]
    for wrong in ({"columns": base | {"colour": "x"}}, {"columns": {"amount": "b"}}, {"columns": base, "currency": "USD"}, {"columns": base, "currency": "USD", "rate": 80.0}, {"columns": base, "rate": 2.0}, {"columns": base, "dataset": "No Name"}, {"columns": base, "date_formats": ()}):
        with pytest.raises(ValueError):
            ingest.Mapping(**wrong)
    m = ingest.load_mapping('{"dataset": "x", "source_currency": " usd", "fx_rate_to_inr": 80, "fx_rate_date": "2024-04-01", "date_formats": ["%d/%m/%Y"], "columns": {"vendor_name": "a", "amount": "b", "txn_date": "c"}}')
    assert (m.currency, m.rate, m.date_formats) == ("USD", 80, ("dd/MM/yyyy",))
    with pytest.raises(ValueError):
        ingest.load_mapping('{"dataset": "x", "colour": 1}')


def test_intake(spark, tmp_path):
    """Guesses, ragged rows, bad bytes, ambiguous dates and files that can't be used."""
    (tmp_path / "a.csv").write_bytes(b"Invoice Amount (INR),Supplier Name,Invoice No,Posting-Date,Extra\n100,Ab\xff Ltd,I1,13/04/2024,x,too,long\n-,B Ltd,I2,01/05/2024\n300,C Ltd,I3,25/12/2024,z\n")
    p = intake.preview_file(spark, f"file://{tmp_path}/a.csv")
    assert p["suggested"] | {"item_desc": None} == {"vendor_name": "Supplier Name", "amount": "Invoice Amount (INR)", "txn_date": "Posting-Date", "invoice_no": "Invoice No", "officer_id": None, "item_desc": None, "item_category": None, "quantity": None, "unit_price": None}
    assert (p["rows"], p["bad_amounts"], p["date_formats"], p["usable"]) == (3, 1, ["%d/%m/%Y"], True) and p["unmapped"] == ["Extra"]
    assert intake.guess(["Creation Date", "Purchase Date"])["txn_date"] is None and intake.near("txn_date", ["Creation Date", "Purchase Date", "x"]) == ["Creation Date", "Purchase Date"]
    both = spark.createDataFrame([("V", "1", "01-04-2024")], "vendor string, amount string, date string")
    p = intake.preview(both)
    assert p["date_formats"] == ["%d-%m-%Y", "%m-%d-%Y"] and not p["usable"] and intake.ambiguous({*p["date_formats"]})
    none = intake.preview(both.limit(0))
    assert none["rows"] == 0 and not none["usable"] and "no data" in none["problems"]
    with pytest.raises(ValueError):
        intake.target("/data", "live", ("/data/live",))


def test_file_to_canonical_table(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Vendor,Amount,Date,Qty\n"Sharma, Traders\nPvt Ltd","Rs. 1,234.50",2024-04-01,2\n,5,2024-04-02,1\nRao & Co,oops,2024-04-02,1\nRao & Co,7,2024-04-03,many\n')
    m = intake.mapping_from("tiny", intake.guess(["Vendor", "Amount", "Date", "Qty"]))
    out = intake.load(spark, f"file://{tmp_path}/b.csv", m, f"file://{tmp_path}/table")
    assert (out["read"], out["loaded"], out["dropped"]["missing_vendor_name"], out["dropped"]["unparseable_amount"], out["coerced"]["quantity"]) == (4, 2, 1, 1, 1)
    rows = spark.read.parquet(f"file://{tmp_path}/table").orderBy("row_id").collect()
    assert [(x.row_id, x.vendor_key, x.amount, x.source_row_ref, x.is_injected) for x in rows] == [(1, "sharma", 1234.5, "1", False), (4, "rao", 7.0, "4", False)]
    assert rows[0].asDict().keys() == dict(tables.CANONICAL).keys() and tables.exists(spark, f"file://{tmp_path}/table") and not tables.exists(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(ValueError):
        tables.replace_table(spark.range(3), f"file://{tmp_path}/table")
    with pytest.raises(ValueError):
        ingest.read_csv(spark, f"file://{tmp_path}/b.csv", ingest.Mapping({"vendor_name": "Nobody", "amount": "Amount", "txn_date": "Date"}))


def test_row_ids_over_files_and_parts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("a\n" + "".join(f"{k}-{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = tables.with_row_ids(tables.read_text_csv(spark, f"file://{tmp_path}", ["a"], multi_line=False)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((x.row_id, x.a) for x in got) == [(k * 5000 + i + 1, f"{k}-{i}") for k in range(3) for i in range(5000)]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/frozen"
    tables.freeze(spark, {"t": spark.range(5)}, root, 7)
    assert tables.prepare(spark, root, f"file://{tmp_path}/work")["seed"] == 7 and spark.read.parquet(f"file://{tmp_path}/work/t").count() == 5
    part = next(p for p in (tmp_path / "frozen" / "t").iterdir() if p.name.startswith("part-"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError):
        tables.verify(spark, root)


@pytest.mark.parametrize(("expression", "value"), [("1+2*3", 7), ("(1+2)*3", 9), ("-2**2", -4), ("2**-1", 0.5), ("₹2,50,000 / 4", 62500), ("7 % -4", -1), ("--3", 3)])
def test_calculator(expression, value):
    assert calculator.evaluate(expression) == value


@pytest.mark.parametrize("expression", ["", "1+", "a+1", "__import__('os')", "1/0", "9**9", "1 2", "(1", "1)", "2**2**9", "1" * 201, "1e999", "True + 1"])
def test_calculator_refuses(expression):
    with pytest.raises(ValueError):
        calculator.evaluate(expression)


def test_stated_values(spark):
    rows = [("amount", "₹ 1,234.57", 1234.565, True), ("amount", "1234.6", 1234.565, True), ("amount", "1234", 1234.565, False), ("amount", "1235", 1234.565, True), ("amount", "about 1235", 1234.565, False), ("amount", "-5", -4.5, True), ("amount", "INR 5", 5.0, True)]
    df = spark.createDataFrame(rows, "field string, stated string, actual double, want boolean")
    assert [x.got for x in df.select(text.same_number(F.col("stated"), F.col("actual")).alias("got")).collect()] == [r[3] for r in rows]
    days = ["2024-04-01", "2024-04-01T10:00", "01-04-2024", "01/04/2024", "1 Apr 2024", "1 April 2024", "Apr 1, 2024", "April 2024"]
    got = [x[0] for x in spark.createDataFrame([(d,) for d in days], "d string").select(text.stated_date(F.col("d"))).collect()]
    assert got == [dt.date(2024, 4, 1)] * 7 + [None]
    null = spark.createDataFrame([(None, None), ("none", None), ("x", None), (None, "A"), (" 'a '", "A")], "stated string, officer_id string")
    assert [x[0] for x in null.select(notes.value_matches(F.lit("officer_id"), F.col("stated"), {"officer_id": F.col("officer_id")})).collect()] == [True, True, False, False, True]


def test_template_notes_pass_their_own_checks(spark):
    tx = ledger(spark, 200)
    found = baseline.detect(tx, Thresholds(approval=60_000.0))
    made = notes.template_notes(found, tx)
    facts = made.select(F.col("case_id").alias("note_id"), F.lit(0).alias("claim_index"), F.explode("facts").alias("f")).select("note_id", "claim_index", "f.row_id", "f.field", F.col("f.value").alias("stated"))
    checked = notes.check_citations(facts, tx, ("amount",))
    assert checked.count() > 0 and checked.where("not value_ok").count() == 0 and made.where("finding is null").count() == 0


def test_sheets(spark):
    chosen = spark.createDataFrame([("c1", "d1", "duplicate"), ("c2", "d2", "split")], "case_id string, detector string, anomaly_type string")
    old = spark.createDataFrame([("c1", "ann", "b1", "unclear", None), ("c1", "bob", "b1", "plausible", None)], "case_id string, reviewer string, batch string, verdict string, comment string")
    fill = lambda *rows: spark.createDataFrame(rows, "line int, case_id string, verdict string, comment string")
    new = review.import_sheet(old, fill((2, " c1 ", "Plausible", " "), (3, "c2", "", "later")), chosen, "ann", "b1")
    assert sorted(tuple(x) for x in new.select("case_id", "reviewer", "verdict").collect()) == [("c1", "ann", "plausible"), ("c1", "bob", "plausible")]
    for rows in ([(2, "c9", "plausible", "")], [(2, "c1", "maybe", "")], [(2, "c1", "", "")]):
        with pytest.raises(ValueError):
            review.import_sheet(old, fill(*rows), chosen, "ann", "b1")


def test_store_of_another_dataset_is_refused(spark):
    cols = "case_id string, dataset string, run_id string, anomaly_type string, detector string, row_ids array<long>, vendor_key string, detector_score double, amount_at_risk double, severity_prelim double, metadata string, band string, status string, investigated boolean, reviewer_note string"
    old = spark.createDataFrame([("a", "x", "r", "split", "d2", [1], "v", 0.5, 1.0, 1.0, "{}", "low", "dismissed", True, "n")], cols)
    new = old.drop("dataset", "run_id", "status", "investigated", "reviewer_note")
    with pytest.raises(ValueError):
        queue.save(old, new, "y", "r2")
    assert queue.save(old, new, "y", "r2", reset=True).first().status == "new" and queue.save(old, new, "x", "r2").first().status == "dismissed"


def test_clauses_of_markdown(spark):
    doc = "# T\n**SG-PP-1.1 — Before any section.**\nText one.\n\n\n\nMore | x\n## 2. Limits\nnot a clause\n**SG-PP-2.1 – Bands**\n| a | b |\n|---|---|\n| c | d |\n"
    got = [(x.clause_id, x.title, x.section, x.text, x.prose) for x in policy.clauses(spark.createDataFrame([(1, doc)], "doc_id long, text string")).orderBy("clause_id").collect()]
    assert got == [("SG-PP-1.1", "Before any section", "Procurement policy", "Text one.\n\nMore | x", "Procurement policy. Before any section. Text one. More | x."), ("SG-PP-2.1", "Bands", "2. Limits", "| a | b |\n|---|---|\n| c | d |", "2. Limits. Bands. | a | b |. c, d.")]


def test_streams(spark, tmp_path):
    """A row seen again within the lateness passes once; totals come by day when the watermark has passed it."""
    from ledgerlens.streaming import fresh_rows, windowed_totals

    schema = "row_id long, at timestamp, vendor string, amount double"
    at = lambda d, h=0: dt.datetime(2025, 4, d, h)
    for k, rows in enumerate(([(1, at(1), "a", 1.0), (2, at(1, 5), "b", 2.0)], [(1, at(1), "a", 1.0), (3, at(2), "a", 4.0)], [(4, at(9), "a", 8.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")

    def run(name, shape, mode):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = shape(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.row_id for r in run("fresh", lambda s: fresh_rows(s, "at", ["row_id"]), "append")) == [1, 2, 3, 4]
    totals = {(r.start.day, r.vendor): (r.n, r.total) for r in run("totals", lambda s: windowed_totals(s, "at", "vendor", "amount"), "append")}
    assert totals[1, "b"] == (1, 2.0) and totals[1, "a"] == (2, 2.0) and (9, "a") not in totals
