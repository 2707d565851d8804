"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes one run: a record for each distinct text, sorted by key (SHA-256 of the normalised text, a second 64-bit hash and the length), with the row that would stay and the number of rows. A run is cut into shards by key and travels as packed arrays.
In round r of a radix-k binomial exchange the runs whose number agrees above digit r meet. They are merged as sorted runs, two at a time up a tournament: places come from binary searches of one run in the other, nothing is sorted again, and a key that both runs have becomes one record with the row that stays of the two, so that every level holds the verified row that stays among all it has seen.
A text that a third of all rows share is one record a run from the start. The winners go back down by (run, key), so no task gets a text's rows of more than one input partition.

Texts are equal when identical after removing the characters of SPACE.

Cases: null text counts as empty; empty texts are equal to each other; of rows with equal texts, code points and doc_id the one of least hash of its text stays, of rows that are the same throughout the first read; a null doc_id orders last; very long texts are hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_text, raw, shuffle_parts, small, tidy, written

RADIX = 8
SHARD_BYTES = 64 << 20
DIGESTS = "doc_id long, run int, pos long, key binary, text_hash long, shard int, records binary"
#: A record; "S" compares byte by byte, and all keys are of one length.
RECORD = np.dtype([("key", "S48"), ("short", "<i8"), ("last", "u1"), ("doc_id", "<i8"), ("text_hash", "<i8"), ("run", "<i4"), ("pos", "<i8"), ("n_rows", "<i8")])
#: Which of two rows stays: the lesser by these fields. short: the number of code points, negative.
STAYS = ("short", "last", "doc_id", "text_hash", "run", "pos")
PACKED = "shard int, parent int, records binary"


def normal(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def key_of(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest() + xxhash.xxh3_64_digest(norm) + len(norm).to_bytes(8, "big")


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a's row stays rather than b's."""
    out, tied = np.zeros(len(a), bool), np.ones(len(a), bool)
    for f in STAYS:
        out |= tied & (a[f] < b[f])
        tied &= a[f] == b[f]
    return out


def merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sorted run of two; of a key that both have one record stays, with the rows of both."""
    at = np.searchsorted(b["key"], a["key"])
    both = np.flatnonzero((at < len(b)) & (b["key"][np.minimum(at, len(b) - 1)] == a["key"])) if len(b) else np.zeros(0, np.int64)
    if len(both):
        a, x, y = a.copy(), a[both], b[at[both]]
        won = np.where(lesser(x, y), x, y)
        won["n_rows"] = x["n_rows"] + y["n_rows"]
        a[both] = won
        left = np.ones(len(b), bool)
        left[at[both]] = False
        b = b[left]
        at = np.searchsorted(b["key"], a["key"])
    out = np.empty(len(a) + len(b), RECORD)
    mine = np.zeros(len(out), bool)
    mine[np.arange(len(a)) + at] = True
    out[mine], out[~mine] = a, b
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several, by a tournament."""
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _records(rows: list[tuple], run: int) -> np.ndarray:
    """A sorted run of a few rows (key, short, last, doc_id, text_hash, pos)."""
    x = np.zeros(len(rows), RECORD)
    for i, f in enumerate(("key", "short", "last", "doc_id", "text_hash", "pos")):
        x[f] = [r[i] for r in rows]
    x["run"], x["n_rows"] = run, 1
    x = x[np.lexsort([x[f] for f in (*reversed(STAYS), "key")])]
    first = np.flatnonzero(np.r_[True, x["key"][1:] != x["key"][:-1]])
    out = x[first]
    out["n_rows"] = np.add.reduceat(x["n_rows"], first)
    return out


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return np.frombuffer(key.tobytes(), np.uint8).reshape(-1, 48)[:, :8].copy().view("<u8").ravel() % np.uint64(shards)


def _digests(shards: int):
    """A row for each document, and at the end the task's run, a row a shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, pos, runs = TaskContext.get().partitionId(), 0, []
        for b in small(batches):
            ids, rows, n = b.column("doc_id"), [], b.num_rows
            for i, (d, t) in enumerate(zip(ids.to_pylist(), raw(b.column("text")), strict=True)):
                points = len(t) - int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80))
                rows.append((key_of(normal(t)), -points, d is None, d or 0, text_hash(t), pos + i))
            runs.append(_records(rows, run))
            while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
                runs[-2:] = [merge_two(runs[-2], runs[-1])]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "run": pa.array([run] * n, pa.int32()), "pos": pa.array(range(pos, pos + n), pa.int64()), "key": pa.array([r[0] for r in rows], pa.binary()), "text_hash": pa.array([r[4] for r in rows], pa.int64()), "shard": pa.nulls(n, pa.int32()), "records": pa.nulls(n, pa.binary())})
            pos += n
        if runs:
            all_of = merged(runs)
            shard = _shard(all_of["key"], shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            parts = [(i, all_of[order[cut[i] : cut[i + 1]]].tobytes()) for i in range(shards) if cut[i] < cut[i + 1]]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "run": pa.array([run] * len(parts), pa.int32()), "pos": none, "key": pa.nulls(len(parts), pa.binary()), "text_hash": none, "shard": pa.array([i for i, _ in parts], pa.int32()), "records": pa.array([x for _, x in parts], pa.binary())})

    return work


def _meet(t: pa.Table) -> pa.Table:
    """The runs of one shard that meet in a round, as one run."""
    one = merged([np.frombuffer(x, RECORD) for x in t.column("records").to_pylist()])
    return pa.table({"shard": t.column("shard").slice(0, 1), "parent": t.column("parent").slice(0, 1), "records": pa.array([one.tobytes()], pa.binary())})


def _keys(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(48), len(x), [None, pa.py_buffer(np.ascontiguousarray(x["key"]).tobytes())]).cast(pa.binary())


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.column("records"):
            x = np.frombuffer(r.as_buffer(), RECORD)
            yield pa.RecordBatch.from_pydict({"key": _keys(x), "run": pa.array(x["run"])})


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.column("records"):
            x = np.frombuffer(r.as_buffer(), RECORD)
            yield pa.RecordBatch.from_pydict({"key": _keys(x), "keep_id": pa.array(x["doc_id"], mask=x["last"] == 1), "keep_run": pa.array(x["run"]), "keep_pos": pa.array(x["pos"]), "group_size": pa.array(x["n_rows"])})


def exact_dedup(docs: DataFrame, radix: int = RADIX) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash for every row of docs; text_hash is of the text as it stands."""
    spark = docs.sparkSession
    shards = max(shuffle_parts(spark), -(-docs.count() * RECORD.itemsize // SHARD_BYTES))
    seen = written(id_text(docs).mapInArrow(tidy(_digests(shards)), DIGESTS), "digests")
    rows = seen.where("shard is null").select("doc_id", "run", "pos", "key", "text_hash")
    runs = seen.where("shard is not null").select("shard", F.col("run").alias("parent"), "records")
    n_runs = (seen.agg(F.max("run")).first()[0] or 0) + 1
    tree, width = runs, 1
    while width < n_runs:
        width *= radix
        parent = (F.floor(F.col("parent") / F.lit(width)) * F.lit(width)).cast("int")
        tree = tree.withColumn("parent", parent).groupBy("shard", "parent").applyInArrow(_meet, PACKED)
    won = tree.mapInArrow(_winners, "key binary, keep_id long, keep_run int, keep_pos long, group_size long")
    down = runs.mapInArrow(_leaves, "key binary, run int").join(won, "key")
    out = rows.join(down, ["run", "key"])
    kept = (F.col("run") == F.col("keep_run")) & (F.col("pos") == F.col("keep_pos"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"), "text_hash")


def op7(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).drop("text_hash")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """docs with the hexadecimal SHA-256 of the normalised text and the hash of the text as it stands as further columns, name and name_text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = raw(b.column(b.schema.names.index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.sha256(normal(t)).hexdigest() for t in texts], pa.string()), pa.array(list(map(text_hash, texts)), pa.int64())], [*b.schema.names, name, f"{name}_text"])

    return docs.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` string, `{name}_text` long")
