import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Thresholds
from ledgerlens.operators import inject, notes, report, synthetic
from ledgerlens.sources import tables

NOTES = "model string, arm string, citations_checked long, citations_passed long"


def test_one_model_is_quoted_and_none_pooled(spark):
    rows = [("big", "agent", 10, 9)] * 19 + [("small", "agent", 1, 0)] * 25 + [("big", "control", 5, 0)] * 40 + [("big", "agent", 3, None)] * 40
    got = report.citation_validity(spark.createDataFrame(rows, NOTES)).first()
    assert (got.model, got.notes, got.checked, got.validity, got.quoted, got.others) == ("small", 25, 25, 0.0, "0.0% over 25 note(s)", "big")
    few = report.citation_validity(spark.createDataFrame(rows[:19], NOTES)).first()
    assert few.quoted == "provisional: 90.0% over 19 note(s)" and few.others == ""
    tied = report.citation_validity(spark.createDataFrame([("b", "agent", 1, 1), ("a", "agent", 0, 0)], NOTES)).first()
    assert (tied.model, tied.validity) == ("a", 0.0)
    assert report.citation_validity(spark.createDataFrame([], NOTES)).count() == 0


def test_long_results_say_that_they_were_cut(spark):
    df = spark.createDataFrame([("x" * 30,), ("y" * 10,), (None,)], "r string").select(notes.kept_result(F.col("r"), 10).alias("r"))
    a, b, c = (x.r for x in df.collect())
    assert json.loads(a) == {"truncated": True, "chars": 30, "head": "x" * 10} and b == "y" * 10 and c is None


def test_a_second_writer_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with tables.writing(spark, path), pytest.raises(tables.WriterError), tables.writing(spark, path):
        pass
    with tables.writing(spark, path):
        pass
    assert [*tmp_path.glob("*.writing")] == []


def test_truth_is_kept_as_csv_too(spark, tmp_path):
    tx = synthetic.ledger(spark, 400)
    rows, truth = inject.duplicates(tx, 5, inject.Plan())
    inject.save(tx.limit(1), truth, inject.Plan(), f"file://{tmp_path}/e")
    flat = spark.read.option("header", True).csv(f"file://{tmp_path}/e/ground_truth_csv").collect()
    kept = {r.group_id: r for r in spark.read.parquet(f"file://{tmp_path}/e/ground_truth").collect()}
    assert len(flat) == 5 and all([int(x) for x in r.row_ids.split(";")] == kept[r.group_id].row_ids for r in flat)


def test_a_demonstration_detects(spark):
    """All four detectors over a window with a few planted groups: copies and splits are found, and the table stays as it is."""
    tx = synthetic.ledger(spark, 6000).cache()
    planted, others = report.demo(tx, {"split": 2, "inflation": 1, "duplicate": 4}, 12, 11, Thresholds())
    got = planted.select("anomaly_type", "detected", "detector").collect()
    caught = lambda kind: [(g.detected, g.detector) for g in got if g.anomaly_type == kind]
    assert caught("duplicate") == [(True, "d1")] * 4 and caught("split") == [(True, "d2")] * 2 and len(caught("inflation")) == 1
    assert tx.count() == 6000 and others.where("detector not in ('d1', 'd2', 'd3', 'd4')").count() == 0
