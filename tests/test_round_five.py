import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa

from ledgerlens.config import Thresholds
from ledgerlens.llm import ctw, token_files
from ledgerlens.llm.common import vocabulary_path
from ledgerlens.operators import runs
from ledgerlens.streaming import split_runs as streamed

FIELDS = "vendor_key string, officer_id string, txn_date date, row_id long, amount double"
SMALL = Thresholds(approval=10.0)


def test_stream_state_does_not_grow_by_vendors(spark, tmp_path):
    """F16: 1,500 vendors' rows wait in no more entries of state than there are buckets, and give the batch operator's runs."""
    r, day = random.Random(7), dt.date(2024, 1, 1)
    rows = [(f"v{v}", r.choice([None, "x"]), day + dt.timedelta(r.randrange(20)), v * 10 + i, r.choice([4.0, 6.5])) for v in range(1500) for i in range(3)]
    want = runs.minimal_runs(spark.createDataFrame(rows, FIELDS), SMALL)
    held, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for batch in (rows, [("zz", None, dt.date(2060, 1, 1), 10**6, 0.01)]):
            spark.createDataFrame(batch, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = streamed.split_runs(spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/in"), SMALL, "3650 days").writeStream.format("parquet")
            query = out.option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            query.awaitTermination()
            held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
        key = lambda x: (x.vendor_key, str(x.officer_id), tuple(x.row_ids), x.total, x.first_date, x.last_date, x.n_parts)
        got = sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect()))
        assert len(got) > 300 and got == sorted(map(key, want.collect()))
        assert 0 < max(held) <= 1024
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bucket_runs_keep_vendors_apart():
    """A window of one call goes on in the next, a null officer is a group of its own, and windows that nothing can join go."""
    d = streamed.DAY_MS
    line = lambda *rows: pa.Table.from_pylist([dict(zip(streamed.HELD.names, x, strict=True)) for x in rows], streamed.HELD)
    first, window = streamed.bucket_runs(line(("a", None, 1, 600, 3 * d), ("a", "x", 2, 600, 3 * d), ("b", None, 3, 600, 0)), 15 * d, 1000, 14)
    assert len(first) == 0 and sorted(window.column("row_id").to_pylist()) == [1, 2]
    pieces = streamed.packed(window) + streamed.packed(line(("a", "x", 4, 400, 16 * d), ("b", None, 5, 600, 16 * d)))
    then, window = streamed.bucket_runs(streamed.unpacked(pieces), 16 * d, 1000, 14)
    assert [(r.vendor_key, r.officer_id, list(r.row_ids), r.total) for r in then.itertuples()] == [("a", "x", [2, 4], 10.0)]
    assert sorted(window.column("row_id").to_pylist()) == [1, 5]


def test_words_are_encoded_once_whatever_follows(monkeypatch):
    """op8: a word is one entry with and without punctuation after it, and ids are those of the whole text."""
    enc = token_files.Encoder(vocabulary_path(token_files.VOCABULARY))
    enc.encode(["x zorbelquat zorbelquat. zorbelquat, zorbelquat!! (zorbelquat) "])
    assert " zorbelquat" in enc.known and not any(p.startswith(" zorbelquat") and p != " zorbelquat" for p in enc.known)
    r = random.Random(11)
    bits = ["a", "Zürich", "\u0120", "naïve", "Ǆ", "ß", "don't", "I'LL", "'s", "x's.", "the", ".", "...", "-'s", "#$%", "7", "3rd", "_a", "\u00d7", "中文", "é", "e\u0301", "\u00ad", "😀", "\x00", "\u2028", "<|end", "<|endoftext|>"]
    gaps = ["", "", " ", " ", " ", "  ", "\n", " \n ", "\t", "\u00a0", "\u3000", "\x1c", "\x85"]
    texts = ["".join(r.choice(bits) + r.choice(gaps) for _ in range(r.randrange(60))) for _ in range(1500)]
    assert enc.encode(texts) == enc._whole(texts)
    monkeypatch.setattr(token_files, "CACHE", 50)
    assert enc.encode(texts[:40]) == enc._whole(texts[:40])


def test_grams_are_counted_by_sorting():
    """op5: distinct grams and training counts as by counting one by one; order by bucket and key."""
    r = np.random.default_rng(3)
    code = np.r_[r.integers(0, 40, 500), r.integers(0, 1 << 56, 50), (1 << 56) - 1]
    train = r.random(len(code)) < 0.6
    keys, count = ctw.counted(code, train)
    assert dict(zip(keys.tolist(), count.tolist(), strict=True)) == {k: int(train[code == k].sum()) for k in set(code.tolist())}
    assert [len(x) for x in ctw.counted(code[:0], train[:0])] == [0, 0]
    for buckets in (7, 1 << 17):
        mixed = r.permutation(keys)
        bucket = ctw.gram_bucket(mixed, buckets)
        order, cut = ctw._ordered(mixed, bucket, buckets)
        assert order.tolist() == np.lexsort((mixed, bucket)).tolist() and cut[-1] == len(keys)


def test_sums_of_a_text_stand_alone(monkeypatch):
    """op5: a text's sum is exact to its own digits after very large ones, and a block in many parts reports what it does in one."""
    assert ctw.totals(np.array([1e17, 0.1, 0.2, -3.0]), np.array([1, 0, 2, 1])).tolist() == [1e17, 0.0, math.fsum([0.1, 0.2]), -3.0]
    texts = ["the cat sat", None, "", "The cat sat on the mat", "é ü 中"] * 9
    t = pa.table({"doc_id": pa.array(range(45), pa.int64()), "text": pa.array(texts), "held_out": pa.array([i % 7 == 2 for i in range(45)]), "block": pa.array([0] * 45, pa.int32())})
    read = lambda f: {(r["kind"], r["bucket"]): (ctw.unpack(r["keys"], "<i8").tolist(), ctw.unpack(r["counts"], "<i8").tolist()) for r in f.to_pylist()}
    one = read(ctw._features(5)(t))
    monkeypatch.setattr(ctw, "PART_BYTES", 64)
    assert len(list(ctw._parts(t))) > 5 and read(ctw._features(5)(t)) == one
