import pathlib

from ledgerlens.config import DEFAULT
from ledgerlens.operators import bands, duplicates, linkage
from ledgerlens.plans import detection
from ledgerlens.sources import scratch
from test_linkage import rows

SMALL = "/root/testdata/sf0.001"


def folder(spark):
    return pathlib.Path(scratch.shared_root(spark).removeprefix("file://"))


def test_counting_stores_no_pairs(spark, monkeypatch):
    """pairs are counted in rounds that give what one gives, none is stored, and a round's lines are gone when it ends."""
    told = linkage.comparable(rows(spark)[0])
    whole = linkage.vector_counts(linkage.reference(told))
    assert sum(linkage.vector_counts(linkage.counted(told, (0, 14))).values()) == linkage.candidates(told).count() > 20
    for d in ((0, 14), (30, 180)):
        assert bands.at_most(told, DEFAULT.dup_tolerance, d) >= bands.band(told, DEFAULT.dup_tolerance, d).count() > 0
    assert bands.at_most(told.where("false")) == 0
    before, stored, kept = set(folder(spark).glob("*")), [], scratch.written
    monkeypatch.setattr(linkage, "written", lambda df, name: (stored.append(name), kept(df, name))[1])
    monkeypatch.setattr(linkage, "ROUND_PAIRS", bands.at_most(told, DEFAULT.dup_tolerance, (30, 180)) // 2)
    assert linkage.vector_counts(linkage.reference(told)) == whole
    assert 1 < stored.count("counted") < 4 and "pairs" not in stored and "candidates" not in stored
    assert set(folder(spark).glob("*")) == before


def test_only_likely_pairs_are_stored(spark, monkeypatch):
    """of all candidates those are stored whose levels can reach the posterior, and they are those that all candidates give."""
    df, _ = rows(spark)
    every = {(r.a_row_id, r.b_row_id): r.posterior for r in linkage.linked(df).collect()}
    least = sorted(every.values())[len(every) // 2]
    sizes, kept = {}, scratch.written
    monkeypatch.setattr(linkage, "written", lambda d, name: sizes.setdefault(name, kept(d, name)) if name == "pairs" else kept(d, name))
    got = {(r.a_row_id, r.b_row_id): r.posterior for r in linkage.linked(df, DEFAULT, least).collect()}
    assert got == {k: p for k, p in every.items() if p >= least} and 0 < len(got) < len(every)
    assert sizes["pairs"].count() < bands.band(linkage.comparable(df)).count()
    likely = {(r.a, r.b) for r in duplicates.evidence(df).where("stage = 'probabilistic'").collect()}
    exact = {(r.a, r.b) for r in duplicates.exact_edges(df).collect()}
    assert likely == {k for k, p in every.items() if p >= DEFAULT.match_posterior} - exact


def test_case_steps_are_stored_and_dropped(spark, monkeypatch):
    """the view is joined once, and of the steps of cases only what the last one reads is left."""
    before, views, kept = set(folder(spark).glob("*")), [], detection.line_items
    monkeypatch.setattr(detection, "line_items", lambda s, d: (views.append(1), kept(s, d))[1])
    got = detection.ENTRIES["d1_exact_cases"][0](spark, SMALL)
    assert {p.name.split("-")[-1] for p in set(folder(spark).glob("*")) - before} == {"found", "grouped"} and len(views) == 1
    n = kept(spark, SMALL).count()
    ids = [r.row_ids.split(",") for r in got.collect()]
    assert len({i for x in ids for i in x}) == sum(map(len, ids)) == 2 * n
