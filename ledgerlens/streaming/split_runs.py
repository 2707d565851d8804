"""Split purchases over a stream: the batch rule with its window held as state.

Vendors and officers are dealt by hash to BUCKETS keys, so that a batch costs a call a bucket and not some for each vendor. Rows wait in the bucket's state, as packed pieces that are not opened, until the watermark passes a day that waits, as rows of an earlier day may still come; then all whose day is over go, in order of day and row id, through the window of their vendor and officer. Windows are state too and hold no more than what a later row may still join to; they go when the watermark leaves them behind. So runs do not depend on how rows were dealt to batches, and a restart goes on from the checkpoint.

Rows that come after the watermark has passed their day are left out, and runs are those of the others. A day's runs are final when the watermark passes it, so rows of the last days wait until later ones come. A vendor and officer is one task's, as its runs follow from one another, and a bucket is held in memory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Thresholds

HELD = pa.schema([("vendor_key", pa.string()), ("officer_id", pa.string()), ("row_id", pa.int64()), ("cents", pa.int64()), ("ms", pa.int64())])
#: The first day that waits, the rows that wait and the windows, both packed.
STATE = "first long, waiting binary, window binary"
RUNS = "vendor_key string, officer_id string, row_ids array<long>, total double, first_date date, last_date date, n_parts int"
DAY_MS = 86_400_000
#: State is dealt by it, so it stays as it is over a checkpoint's life.
BUCKETS = 1024
NEVER = 1 << 62
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(window: list[tuple], rows: list[tuple], limit: int, days: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Runs that end in rows, and the window after them. Both hold (ms, row_id, cents) in order; all cents are above 0."""
    runs, total, held, start = [], sum(w[2] for w in window), [*window, *rows], 0
    for at in range(len(window), len(held)):
        ms, _, cents = held[at]
        while ms - held[start][0] > days * DAY_MS:
            total -= held[start][2]
            start += 1
        total += cents
        if total >= limit:
            while total - held[start][2] >= limit:
                total -= held[start][2]
                start += 1
            runs.append(held[start : at + 1])
            start, total = at + 1, 0
    return runs, held[start:]


def packed(t: pa.Table) -> bytes:
    """Rows as one piece, with its length before it, so that pieces can be strung together."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    piece = sink.getvalue().to_pybytes()
    return len(piece).to_bytes(8, "little") + piece


def unpacked(pieces: bytes) -> pa.Table:
    at, tables, view = 0, [HELD.empty_table()], memoryview(pieces)
    while at < len(view):
        size = int.from_bytes(view[at : at + 8], "little")
        tables.append(pa.ipc.open_stream(pa.py_buffer(view[at + 8 : at + 8 + size])).read_all())
        at += 8 + size
    return pa.concat_tables(tables)


def bucket_runs(rows: pa.Table, now: int, limit: int, days: int) -> tuple[pd.DataFrame, pa.Table]:
    """Runs of a bucket's windows and rows whose day is over, and the windows after them that a row of a day after now may join to."""
    vendor, officer = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("vendor_key", "officer_id"))
    key = vendor.indices.to_numpy().astype(np.int64) * (len(officer.dictionary) + 1) + officer.indices.to_numpy()
    ms, row_id, cents = (rows.column(c).to_numpy() for c in ("ms", "row_id", "cents"))
    order = np.lexsort((cents, row_id, ms, key))
    key = key[order]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    # In place of its id a row goes by its place here.
    line = list(zip(ms[order].tolist(), order.tolist(), cents[order].tolist(), strict=True))
    found, left = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        runs, window = fold([], line[a:b], limit, days)
        found += runs
        if window and window[-1][0] + days * DAY_MS > now:  # whatever comes else is of a day that is too late to join
            left += [w[1] for w in window]
    of = rows.take(pa.array([r[0][1] for r in found], pa.int64()))
    day = lambda ms: dt.date(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    out = {
        "vendor_key": of.column("vendor_key").to_pylist(), "officer_id": of.column("officer_id").to_pylist(), "row_ids": [row_id[[x[1] for x in r]] for r in found],
        "total": [sum(x[2] for x in r) / 100 for r in found], "first_date": [day(r[0][0]) for r in found], "last_date": [day(r[-1][0]) for r in found], "n_parts": [len(r) for r in found],
    }
    return pd.DataFrame(out), rows.take(pa.array(left, pa.int64()))


def _step(limit: int, days: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A bucket's new rows, or the time that it asked for."""
        now = state.getCurrentWatermarkMs()
        first, waiting, window = state.get if state.exists else (NEVER, b"", b"")
        if not state.hasTimedOut:
            for b in batches:
                if len(b):
                    waiting, first = waiting + packed(pa.Table.from_pandas(b[HELD.names], HELD, preserve_index=False).replace_schema_metadata()), min(first, int(b["ms"].min()))
        asked = first
        if first <= now or state.hasTimedOut:
            rows = unpacked(waiting)
            over = rows.column("ms").to_numpy() <= now
            rest = rows.filter(pa.array(~over))
            runs, left = bucket_runs(pa.concat_tables([unpacked(window), rows.filter(pa.array(over))]), now, limit, days)
            first = int(rest.column("ms").to_numpy().min()) if rest.num_rows else NEVER
            waiting, window = (packed(t) if t.num_rows else b"" for t in (rest, left))
            asked = first if rest.num_rows or not left.num_rows else int(left.column("ms").to_numpy().max()) + days * DAY_MS
            if len(runs):
                yield runs
        if waiting or window:
            state.update((first, waiting, window))
            state.setTimeoutTimestamp(max(asked - 1, now + 1))  # the watermark has to be beyond it
        elif state.exists:
            state.remove()

    return step


def split_runs(stream: DataFrame, t: Thresholds = DEFAULT, lateness: str = "7 days") -> DataFrame:
    """The runs of operators.runs.minimal_runs over a stream of audit rows that come at most lateness after a row of a later day. Sets the session's state store to RocksDB, so that state is not held in memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    cents = (F.col("amount").cast("decimal(18,2)") * 100).cast("long")
    day = F.timestamp_millis(F.unix_date("txn_date").cast("long") * DAY_MS)
    bucket = F.pmod(F.hash("vendor_key", "officer_id"), F.lit(BUCKETS)).alias("bucket")
    rows = stream.where(F.col("amount") < t.approval).select(bucket, "vendor_key", "officer_id", "row_id", cents.alias("cents"), (F.unix_date("txn_date").cast("long") * DAY_MS).alias("ms"), day.alias("day"))
    rows = rows.withWatermark("day", lateness).where("cents > 0")
    return rows.groupBy("bucket").applyInPandasWithState(_step(round(t.approval * 100), t.split_days), RUNS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
