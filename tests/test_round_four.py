import datetime as dt
import pathlib

from pyspark.sql import functions as F

from ledgerlens.config import Thresholds
from ledgerlens.operators import duplicates, evaluate, explore, graph, indexes, inject, ranks, runs
from ledgerlens.plans import detection
from ledgerlens.sources import adapter, scratch

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_exact_edges_shuffle_rows_once(spark):
    """rows are dealt by key once, and each line item booked twice is read once; the edges are those of a plain count."""
    day = dt.date(2025, 4, 1)
    rows = [(i, f"v{i % 3}", float(i % 2), [" A1", "a1 ", "b", None][i % 4], day) for i in range(48)] + [(99, None, 1.0, "b", day), (98, None, 1.0, "b", day)]
    tx = spark.createDataFrame(rows, "row_id long, vendor_key string, amount double, invoice_no string, txn_date date")
    first = {}
    for i, v, m, n, _ in sorted(rows):
        first.setdefault((v, m, n and n.strip().lower()), i)
    want = sorted((a, i) for i, v, m, n, _ in rows if n and v and (a := first[v, m, n.strip().lower()]) != i)
    edges = duplicates.exact_edges(tx)
    assert sorted(map(tuple, edges.collect())) == want and want
    assert plan(edges).count("Exchange hashpartitioning") == 1
    assert plan(duplicates.exact_edges(detection.twice(spark, SMALL))).count("lineitem.parquet") == 1


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """a table whose files are large is not sent whole, however few of its columns are read."""
    assert "BroadcastHashJoin [l_partkey" in plan(adapter.line_items(spark, SMALL).select("row_id"))
    monkeypatch.setattr(adapter, "BROADCAST_FILES", 1)
    assert "Broadcast" not in plan(adapter.line_items(spark, SMALL)) + plan(adapter.orders(spark, SMALL))


def test_scratch_is_discarded(spark):
    """a scratch table is gone when it is discarded, and what was shuffled for a written one is cleaned up."""
    df = scratch.written(spark.range(10).repartition(2), "kept")
    assert df.count() == 10 and spark.conf.get(scratch.CLEANED, "false") == "false"
    files = df.inputFiles()
    scratch.discard(df)
    assert files and spark.sparkContext._jvm.java.io.File(files[0].removeprefix("file://")).exists() is False


def test_stars_need_no_rounds(spark, monkeypatch):
    """edges from each group's least id, as exact matches give, are not taken through rounds; a chain and an id with two lesser neighbours still are."""
    edges = [(1, 2), (1, 3), (7, 9), (7, 7), (9, 7)]
    named = lambda e: spark.createDataFrame(e, "a long, b long")
    rounds = []
    kept = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (rounds.append(1), kept(df))[1])
    assert sorted(map(tuple, graph.components(named(edges)).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)] and not rounds
    for more in ([(3, 4)], [(2, 9)]):
        rounds.clear()
        got = dict(map(tuple, graph.components(named(edges + more)).collect()))
        assert rounds and got == ({1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7} if more == [(3, 4)] else dict.fromkeys((1, 2, 3, 7, 9), 1))


def test_metrics_make_cases_once(spark, monkeypatch):
    """cases and groups are stored once, so that what they are made from is not read again, and a run's numbered rows are gone when it is there."""
    names, kept = [], scratch.written
    monkeypatch.setattr(evaluate, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        reads.add(1)
        return float(x)

    cases = spark.createDataFrame([("split", "a", 1, [1, 2], "v"), ("split", "b", 2, [3], "v")], "anomaly_type string, case_id string, n int, row_ids array<long>, vendor_key string").withColumn("score", score("n"))
    truth = spark.createDataFrame([("split", "g", [1, 2, 4], "v")], "anomaly_type string, group_id string, rows array<long>, vendor_key string")
    got = {x.granularity: tuple(x)[2:5] for x in evaluate.metrics(cases, truth).where("anomaly_type = 'split'").collect()}
    assert got == {"case": (1, 1, 0), "row": (2, 1, 1)} and reads.value == 2 and names[:2] == ["judged", "truth"]


def test_running_keeps_one_copy(spark):
    """of a table that is ranked one stored copy is left, and none of a run's numbered rows."""
    before = set(pathlib.Path(scratch.shared_root(spark).removeprefix("file://")).glob("*"))
    ranks.running(spark.range(20).withColumn("v", F.col("id") % 7), ["v", "id"], rank="n").collect()
    runs.minimal_runs(adapter.line_items(spark, SMALL)).collect()
    left = [p.name.split("-")[-1] for p in set(pathlib.Path(scratch.shared_root(spark).removeprefix("file://")).glob("*")) - before]
    assert "unranged" not in left and "numbered" not in left and "runs" in left


def test_many_are_chosen_by_bins(spark, monkeypatch):
    """of many rows those up to the bin of the n-th draw are numbered, none in one task, and they are those that one sort gives."""
    rows = spark.range(3000).withColumnRenamed("id", "row_id")
    few = sorted(map(tuple, inject.chosen(rows, 700, 1, "x").collect()))
    monkeypatch.setattr(inject, "FEW", 10)
    many = inject.chosen(rows, 700, 1, "x")
    assert sorted(map(tuple, many.collect())) == few and len(few) == 700 and "TakeOrdered" not in plan(many)
    assert inject.chosen(rows, 5000, 1, "x").count() == 3000


def test_splits_store_what_is_chosen_only(spark, monkeypatch):
    """of all rows that could be cut nothing is stored but those that are taken."""
    stored, kept = {}, scratch.written
    monkeypatch.setattr(inject, "written", lambda df, name: stored.setdefault(name, kept(df, name)))
    rows, truth, gone = inject.splits(adapter.line_items(spark, SMALL), 5, inject.Plan(), Thresholds(approval=20_000.0))
    assert gone.count() == truth.count() == 5 and rows.count() >= 15
    assert {k: v.count() for k, v in stored.items()} == {"split": 5}


def test_index_counts_words_in_their_text(spark, tmp_path, monkeypatch):
    """words are counted where their text is, nothing is shuffled for it, terms are gone when the index is there, and files of a folder hold whole blocks."""
    seen, kept = [], scratch.written
    monkeypatch.setattr(indexes, "written", lambda df, name: (seen.append((plan(df), kept(df, name))), seen[-1][1])[1])
    monkeypatch.setattr(indexes, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(indexes, "FILE_BLOCKS", 4)
    docs = spark.createDataFrame([(i, "a b a c" if i % 2 else None) for i in range(40)] + [(None, "b b")], "doc_id long, text string")
    indexes.write_lexical(docs, f"{tmp_path}/index")
    assert "Exchange" not in seen[0][0] and not pathlib.Path(seen[0][1].inputFiles()[0].removeprefix("file://")).exists()
    assert tuple(spark.read.parquet(f"{tmp_path}/index/stats").first()) == (41, 82)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/words").collect()} == {("a", 20), ("b", 21), ("c", 20)}
    held = indexes.postings(spark, f"{tmp_path}/index", ["b"]).select("block", F.inline("texts")).collect()
    assert sorted((r.doc_id or -1, r.tf, r.len) for r in held) == sorted([(i, 1, 4) for i in range(1, 40, 2)] + [(-1, 2, 2)])


def test_similar_rows_drop_their_copy(spark):
    """the rows that both legs are made of are gone when the legs have their own."""
    folder = pathlib.Path(scratch.shared_root(spark).removeprefix("file://"))
    before = set(folder.glob("*"))
    assert explore.similar_rows(adapter.line_items(spark, SMALL), 1).count() > 0
    assert not [p for p in set(folder.glob("*")) - before if p.name.endswith("looked-up")]
