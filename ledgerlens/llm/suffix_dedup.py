"""Removal of passages that repeat across documents, by suffix arrays.

Every WINDOW-byte string holds an anchor: the K-gram of least hash among its K-grams, the first of equals. It depends on the string alone, so equal strings have equal anchors at equal places. Windows in a row with one anchor form a phrase (the bytes they cover).
1. Blocks of documents report their distinct anchors; those of two documents or more are shared.
2. Blocks send the phrases of shared anchors to buckets by anchor; of equal phrases in a block only the least doc_id's goes on, as the others are repeats already.
3. A bucket groups an anchor's phrases. Equal phrases repeat whole. If an anchor has several different phrases, their windows are grouped by the suffix array of the phrases, and each window takes the least doc_id of its group.
4. Windows whose least doc_id is smaller than their document's go back to the block; the union of their spans is removed.

Suffix array: linear grouping. Suffixes are grouped by first symbol; groups are processed in descending order, and each suffix's previous smaller suffix (nearest to the left in a lower group) has its group's prefix extended by the processed one, as often as it is pointed at. In the end groups are Lyndon prefixes in order. Then, in ascending order, each placed suffix places the one before it and what that points back to, at the front of their groups. No renaming and no recursion.

Cases: null text is empty; texts shorter than WINDOW lose nothing; repeated rows with one doc_id don't repeat each other; a null doc_id counts as greater than all; texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count, id_text, raw, shuffle_parts

WINDOW = 50
K = 24
SPAN = WINDOW - K + 1
PACK = 7
LAST = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]
ANCHORS = "bucket int, block int, hashes binary, many binary"
PHRASES = "bucket int, block int, meta binary, bytes binary"
SPANS = "block int, meta binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


CHUNK = 4 << 20
BLOCKS = 2  # blocks of documents to a shuffle partition


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


with np.errstate(over="ignore"):
    _BYTES = _mixed(np.arange(256, dtype=np.uint64) * _MIX[0] + np.uint64(77))
_POWER = {w: np.uint64(pow(0xD6E8FEB86659FD93, w, 1 << 64)) for w in (1, 2, 4, 8)}


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, first byte and end of each phrase, and the anchor's place in it."""
    out = [[], [], [], [], []]
    of, base, parts = [], [], []
    for i, t in enumerate(texts):  # very long texts in overlapping parts, which have each window once
        for b in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            of.append(i)
            base.append(b)
            parts.append(t[b : b + CHUNK + WINDOW - 1] if len(t) > CHUNK else t)
    of, base = np.array(of, np.int64), np.array(base, np.int64)
    size = np.array([len(t) for t in parts], np.int64)
    at = 0
    while at < len(parts):
        upto, total = at + 1, size[at]
        while upto < len(parts) and total + size[upto] < CHUNK:
            total += size[upto]
            upto += 1
        big = np.frombuffer(b"".join(parts[at:upto]), np.uint8)
        ends = np.cumsum(size[at:upto])
        n_windows = len(big) - WINDOW + 1
        if n_windows > 0:
            with np.errstate(over="ignore"):
                h = _BYTES[big]
                for w in (1, 2, 4):
                    h = h[:-w] * _POWER[w] + h[w:]
                half = h[:-8] * _POWER[8] + h[8:]
                h = _mixed(half[:-8] * _POWER[8] + h[16:])
            pos = _first_least(h, n_windows)
            doc = np.repeat(np.arange(upto - at), size[at:upto])[:n_windows]
            s = np.flatnonzero(np.arange(n_windows) + WINDOW <= ends[doc])
            if len(s):
                p = pos[s]
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                last = np.r_[first[1:], len(s)] - 1
                d = doc[s[first]]
                begin = ends[d] - size[at:upto][d]
                for o, v in zip(out, (h[p[first]], of[at:upto][d], s[first] - begin + base[at:upto][d], s[last] + WINDOW - begin + base[at:upto][d], p[first] - s[first]), strict=True):
                    o.append(v)
        at = upto
    return np.concatenate([*out[0], np.zeros(0, np.uint64)]), *(np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64) for o in out[1:])


def _first_least(h: np.ndarray, n: int) -> np.ndarray:
    """Place of the first least of h[i : i + SPAN], by its upper 40 bits, for each i < n; fewer than 2**24 places."""
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[width:], low[:-width])
        width *= 2
    rest = SPAN - width
    return (np.minimum(low[rest:], low[: len(low) - rest])[:n] & np.uint64(0xFFFFFF)).astype(np.int64)


def suffix_array(t: list[int] | bytes) -> list[int]:
    """Suffixes of t in order, the empty one left out. Linear grouping; see the module's text."""
    n = len(t)
    if not n:
        return []
    order = sorted(set(t))
    number = {c: i for i, c in enumerate(order)}
    group = [number[c] for c in t]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    lower, upper = [i - 1 for i in range(len(order))], [*range(1, len(order)), -1]
    prev, done = [-1] * n, [False] * n
    g = len(order) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]  # those that moved up are listed there too
        pointed: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and (done[j] or group[j] == g):
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        for i in mine:
            done[i] = True
        # Suffixes pointed at equally often, out of one group, form a group just above what is left of it.
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((group[j], times), []).append(j)
        if len(moved) > 1:
            todo = sorted(moved.items(), key=lambda x: x[0][1], reverse=True)
        else:
            todo = list(moved.items())
        for (h, _), who in todo:
            if len(who) == size[h]:
                continue  # the whole of what is left moves up: it stays where it is
            new = len(members)
            up = upper[h]
            members.append(who)
            size.append(len(who))
            size[h] -= len(who)
            lower.append(h)
            upper.append(up)
            upper[h] = new
            if up >= 0:
                lower[up] = new
            for j in who:
                group[j] = new
        g = lower[g]
    # Groups in ascending order: begin of each in the result.
    g = next(i for i in range(len(lower)) if lower[i] < 0)
    begin, at = [0] * len(members), 0
    while g >= 0:
        begin[g] = at
        at += size[g]
        g = upper[g]
    out, placed = [-1] * n, [False] * n
    j = n - 1  # the empty suffix comes first and places what is before it
    k = -1
    while True:
        while j >= 0 and not placed[j]:
            b = begin[group[j]]
            out[b] = j
            begin[group[j]] = b + 1
            placed[j] = True
            j = prev[j]
        k += 1
        if k >= n:
            return out
        j = out[k] - 1


def symbols(p: bytes, off: int) -> list[int]:
    """A phrase for the suffix array of its anchor's phrases. All their windows hold the anchor, so it is one symbol, and what follows it is taken PACK bytes a symbol, as numbers of the same order; only what comes before it, where windows begin, is byte by byte."""
    right = p[off + K :]
    return [*(b + 1 for b in p[:off]), 257, *(int.from_bytes(right[i : i + PACK].ljust(PACK, b"\0"), "big") * (PACK + 1) + len(right[i : i + PACK]) + 258 for i in range(0, len(right), PACK)), 0]


def least_owner(phrases: list[bytes], offs: list[int], owner: list[int]) -> list[list[int]]:
    """For each window of each phrase the least owner of all phrases' equal windows. offs: where the anchor is, the same K bytes in all."""
    text: list[int] = []
    phrase, place = [], []  # of each symbol, -1 where no window begins
    for q, (p, off) in enumerate(zip(phrases, offs, strict=True)):
        x, n = symbols(p, off), len(p) - WINDOW + 1
        text += x
        phrase += [q] * n + [-1] * (len(x) - n)
        place += range(len(x))
    out = [[owner[q]] * (len(p) - WINDOW + 1) for q, p in enumerate(phrases)]
    run: list[int] = []
    before = b""
    for i in [*suffix_array(text), -1]:
        q = phrase[i] if i >= 0 else -2
        if q == -1:
            continue
        x = phrases[q][place[i] : place[i] + WINDOW] if q >= 0 else b""
        if x != before:
            if len(run) > 1:
                least = min(owner[phrase[j]] for j in run)
                for j in run:
                    out[phrase[j]][place[j]] = least
            run, before = [], x
        run.append(i)
    return out


def _sorted(t: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    t = t.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return t, raw(t.column("text")), t.column("doc_id").fill_null(LAST).to_numpy()


def _blobs(bucket: np.ndarray, buckets: int, order: np.ndarray):
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in range(buckets):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i] : cut[i + 1]]


def _anchor_rows(buckets: int):
    def work(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        _, texts, ids = _sorted(t)
        h, d, _, _, _ = anchors(texts)
        order = np.lexsort((ids[d], h))
        h, d = h[order], ids[d[order]]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(h)] - 1 if len(h) else first
        h, many = h[first], d[first] != d[last]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        rows = [(i, block, (h[o] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), np.packbits(many[o]).tobytes()) for i, o in _blobs(bucket, buckets, np.argsort(bucket, kind="stable"))]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary()), "many": pa.array([r[3] for r in rows], pa.binary())})

    return work


def _wide(b: bytes) -> np.ndarray:
    """Numbers of 7 bytes."""
    x = np.zeros((len(b) // 7, 8), np.uint8)
    x[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return x.view("<u8").ravel()


def _shared(t: pa.Table) -> pa.Table:
    """Anchors of two documents or more, back to each block that has them. Seven bytes of an anchor's hash are kept; a false meeting costs a look, no result."""
    rows = t.to_pylist()
    h = [_wide(r["hashes"]) for r in rows]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(x)).astype(bool) for r, x in zip(rows, h, strict=True)])
    big = np.concatenate(h)
    order = np.argsort(big, kind="stable")
    s = big[order]
    same = s[1:] == s[:-1]
    flag = np.empty(len(big), bool)
    flag[order] = np.r_[False, same] | np.r_[same, False]
    parts = np.split(flag | many, np.cumsum([len(x) for x in h])[:-1])
    return pa.table({"bucket": t.column("bucket"), "block": t.column("block"), "hashes": pa.array([x[f].view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for x, f in zip(h, parts, strict=True)], pa.binary()), "many": pa.array([b""] * len(rows), pa.binary())})


def _phrase_rows(buckets: int):
    """Phrases of shared anchors to their buckets, with doc_id, row and place; bucket -1 has spans that repeat within the block."""

    def work(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "meta": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})
        block = docs.column("block")[0].as_py()
        _, texts, ids = _sorted(docs)
        h, d, s, e, off = anchors(texts)
        known = {r["bucket"]: np.sort(_wide(r["hashes"])) for r in shared.to_pylist()}
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        rows, spans = [], []
        pack = zstandard.ZstdCompressor(level=3)
        for i, o in _blobs(bucket, buckets, np.argsort(bucket, kind="stable")):
            if not len(want := known.get(i, np.zeros(0, np.uint64))):
                continue
            x = (h[o] // np.uint64(buckets)) & np.uint64((1 << 56) - 1)
            o = o[want[np.minimum(np.searchsorted(want, x), len(want) - 1)] == x]
            o = o[np.argsort(d[o], kind="stable")]  # rows are in doc_id order
            seen: dict[bytes, int] = {}
            keep, data = [], []
            for j, row, a, b in zip(o.tolist(), d[o].tolist(), s[o].tolist(), e[o].tolist(), strict=True):
                p = texts[row][a:b]
                owner = seen.setdefault(p, row)
                if ids[owner] < ids[row]:
                    spans.append((row, a, b))
                elif owner == row or ids[owner] == ids[row]:
                    keep.append(j)
                    data.append(p)
            if keep:
                k = np.array(keep)
                meta = [off[k].astype("<u1"), ids[d[k]].astype("<i8"), d[k].astype("<u4"), s[k].astype("<i8"), (e[k] - s[k]).astype("<u1")]
                rows.append((i, block, pack.compress(b"".join(c.tobytes() for c in meta)), pack.compress(b"".join(data))))
        if spans:
            rows.append((-1, block, np.array(spans, "<i8").tobytes(), b""))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "meta": pa.array([r[2] for r in rows], pa.binary()), "bytes": pa.array([r[3] for r in rows], pa.binary())})

    return work


def _mates(phrases, offs: dict[bytes, int]) -> list[bytes]:
    """Phrases of an anchor that may share a window with another: of the WINDOW - K bytes around the anchor, half or more lie on one side, so that they share that half."""
    half = (WINDOW - K) // 2
    left = {p: p[offs[p] - half : offs[p]] if offs[p] >= half else None for p in phrases}
    right = {p: p[offs[p] + K : offs[p] + K + half] if len(p) - offs[p] - K >= half else None for p in phrases}
    n_left, n_right = Counter(left.values()), Counter(right.values())
    return [p for p in phrases if left[p] is not None and n_left[left[p]] > 1 or right[p] is not None and n_right[right[p]] > 1]


def _repeats(t: pa.Table) -> pa.Table:
    """Spans of windows that also start in a document of smaller doc_id: row, first byte and end, by block."""
    groups: dict[bytes, dict[bytes, list[tuple[int, int, int, int]]]] = {}
    offs: dict[bytes, int] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for r in t.to_pylist():
        at, data, meta, cols, skip = 0, unpack(r["bytes"]), unpack(r["meta"]), [], 0
        for kind in ("<u1", "<i8", "<u4", "<i8", "<u1"):
            cols.append(np.frombuffer(meta, kind, len(meta) // 22, skip).tolist())
            skip += len(meta) // 22 * np.dtype(kind).itemsize
        for off, doc, row, s, n in zip(*cols, strict=True):
            p = data[at : at + n]
            groups.setdefault(p[off : off + K], {}).setdefault(p, []).append((doc, r["block"], row, s))
            offs[p] = off
            at += n
    found: dict[int, list[tuple[int, int, int]]] = {}
    for phrases in groups.values():
        least = [min(x)[0] for x in phrases.values()]
        for p, who, m in zip(phrases, phrases.values(), least, strict=True):
            for doc, block, row, s in who:
                if doc > m:
                    found.setdefault(block, []).append((row, s, s + len(p)))
        mates = _mates(phrases, offs) if len(phrases) > 1 else []
        if len(mates) > 1:
            own = [min(phrases[p])[0] for p in mates]
            for p, m, got in zip(mates, own, least_owner(mates, [offs[p] for p in mates], own), strict=True):
                who = phrases[p]
                for k, owner in enumerate(got):
                    if owner < m:
                        for doc, block, row, s in who:
                            if doc == m:
                                found.setdefault(block, []).append((row, s + k, s + k + WINDOW))
    return pa.table({"block": pa.array(list(found), pa.int32()), "meta": pa.array([np.array(v, "<i8").tobytes() for v in found.values()], pa.binary())})


def _removed(docs: pa.Table, spans: pa.Table) -> pa.Table:
    t, texts, _ = _sorted(docs)
    found = np.concatenate([np.frombuffer(m, "<i8").reshape(-1, 3) for m in spans.column("meta").to_pylist()] or [np.zeros((0, 3), np.int64)])
    found = found[np.argsort(found[:, 0], kind="stable")]
    cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    spans_of, kept = [], []
    for i, x in enumerate(texts):
        if cut[i] == cut[i + 1]:
            spans_of.append([])
            kept.append(x)
            continue
        step = np.zeros(len(x) + 1, np.int64)
        np.add.at(step, found[cut[i] : cut[i + 1], 1], 1)
        np.add.at(step, found[cut[i] : cut[i + 1], 2], -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        spans_of.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        kept.append(np.frombuffer(x, np.uint8)[~gone].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "spans": pa.array(spans_of, kind), "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, maximal runs) and kept (the remaining bytes) of every row. kept is binary, as a removed run may end inside a character."""
    spark = docs.sparkSession
    buckets = group_count(docs)
    dealt = lambda df, by: df.repartition(buckets, by) if buckets > shuffle_parts(spark) else df
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS * buckets)).cast("int")
    docs = id_text(docs).withColumn("block", block)
    docs = docs.repartition(buckets, "block") if buckets > shuffle_parts(spark) else docs.repartition("block")  # one exchange, used three times
    found = dealt(docs.groupBy("block").applyInArrow(_anchor_rows(buckets), ANCHORS), "bucket").groupBy("bucket").applyInArrow(_shared, ANCHORS)
    phrases = docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_phrase_rows(buckets), PHRASES)
    spans = dealt(phrases.where("bucket >= 0"), "bucket").groupBy("bucket").applyInArrow(_repeats, SPANS).union(phrases.where("bucket < 0").select("block", "meta"))
    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_removed, RESULT)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, from the spans and kept bytes."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return suffix_dedup(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
