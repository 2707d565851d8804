import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT
from ledgerlens.functions.names import similarity_of
from ledgerlens.operators import bands, linkage

DAY = dt.date(2025, 4, 1)
FIELDS = "row_id long, vendor_name string, vendor_key string, invoice_no string, amount double, txn_date date, officer_id string, item_category string, quantity double"


def names(seed, n):
    r = random.Random(seed)
    words = ["Sharma", "Traders", "Saxena", "Petroleum", "Petrolium", "Gupta", "and", "Sons", "Ltd", "Pvt", "aa", "aaa", "ab", "Mehta", "Mehtaa", "M/s"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(n)] + ["", "Sharma", "amrahS"]


def test_letters_rule_out_no_alike_names(spark):
    """Every pair of names that is alike enough passes the bound, and the bound leaves many others out."""
    every = sorted({*names(1, 60)})
    pairs = spark.createDataFrame([(a, b) for a in every for b in every], "p_vendor_name string, q_vendor_name string")
    got = {(r.p_vendor_name, r.q_vendor_name): r.sim for r in linkage.similar_names(pairs).collect()}
    want = {(a, b): similarity_of(a, b) for a in every for b in every if similarity_of(a, b) >= DEFAULT.name_confirm}
    assert got == want and len(want) < len(every) ** 2 / 2


def rows(spark, seed=2, n=120):
    r, known = random.Random(seed), names(3, 12)
    out = []
    for i in range(n):
        name = r.choice(known)
        out.append((i, name, name.lower(), r.choice([None, f"INV-{i % 9:04d}", f"inv-{i % 9:04d} "]), r.choice([100.0, 100.3, 101.0, 250.0]), DAY + dt.timedelta(r.randrange(120)), r.choice(["x", "y", None]), r.choice(["p", "q"]), r.choice([1.0, 2.0, None])))
    return spark.createDataFrame(out, FIELDS), out


def test_reference_counts_are_those_of_the_pairs(spark):
    """Counts by names and levels, and the pairs one by one, give the same vectors."""
    df, out = rows(spark)
    by_id = {x[0]: x for x in out}
    told = linkage.comparable(df)
    each = linkage.levels(bands.band(told, DEFAULT.dup_tolerance, DEFAULT.reference_days)).select("p_row_id", "q_row_id", "invoice", "context", "date_gap").collect()
    want = {}
    for x in each:
        sim = similarity_of(by_id[x.p_row_id][1], by_id[x.q_row_id][1])
        if sim >= DEFAULT.name_confirm:
            v = (0 if sim >= 95 else 1 if sim >= 88 else 2, x.invoice, x.context, x.date_gap)
            want[v] = want.get(v, 0) + 1
    assert len(want) > 5 and linkage.vector_counts(linkage.reference(told)) == want


def test_candidates_are_ordered_pairs(spark):
    df, out = rows(spark, 4)
    got = linkage.candidates(linkage.comparable(df)).collect()
    want = {(a[0], b[0]) for a in out for b in out if a[0] < b[0] and abs(a[4] - b[4]) < 0.005 * max(a[4], b[4]) and abs((a[5] - b[5]).days) <= 14 and similarity_of(a[1], b[1]) >= DEFAULT.name_confirm}
    assert len(want) > 20 and {(r.a_row_id, r.b_row_id) for r in got} == want and len(got) == len(want)
    assert linkage.model_frame(df.limit(0)).count() == 14
    assert linkage.candidates(linkage.comparable(df.where(F.lit(False)))).count() == 0
