"""N-gram Jaccard self-join on sets of word shingles, with set-relation skipping.

Sets. Words are lower-cased (A-Z) and hashed; a document's set holds the 64-bit hashes of its distinct SHINGLE-word runs, or of the whole sequence if it has fewer words. Equal sets are one class from the start, per task before anything moves.

Index. A set's members are ordered by how common they are (a fixed-size count sketch over all documents, summed in chunks), then by hash. Two sets that link share a member among the first n - ceil(t n) + 1 of each, so only those prefixes are indexed. Postings go to buckets as packed arrays.

Long lists are cut into parts by a hash of the set, and every two parts meet in a group of their own, so no task holds a long list.

Index-level skipping. In a bucket each list is sorted by set size and cut into blocks of the sizes that may link; within a block entries are ordered by the member's position in its set, and once the position leaves too little overlap for the smallest required, the rest of the block is skipped.

Answer-level skipping. Each list is first compared with one set only, its pivot (the least key). What links to a pivot is in its class; a list whose entries are all of one class is done, so a group of near copies costs one pair for each copy. In the remaining lists, for entry x with known |x & p| and y with known |p & y|, the answer on (x, y) follows from the pivot's: |x & y| <= |p & y| + |x| - |x & p|, and only pairs for which this does not settle it go on. Of any candidates only those are computed whose parity signatures differ in no more bits than linked sets may in members. So every link between different classes is found: the classes are exact.

Cases: null or empty text and texts without words have an empty set, are linked with nothing and keep their own id; repeated rows are equal sets; rows of one doc_id with different texts are documents of their own, which link or not by their texts; rows with a null doc_id link like others, but null is never a class id unless all members' are null; very long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, checkpointed, discard, group_count, id_text, lower_words, raw, small, tidy, tree_sum, written

SHINGLE = 5
NUM, DEN = 75, 100
SKETCH_BITS, CHUNK_BITS = 20, 12
SHORT = 64
LIST_PART = 2048  # entries of a list that are compared with each other, or with as many others, in one group
NEAREST_ROUNDS = 1
PAIRS_HELD = 1_000_000
BLOOM_BITS, BLOOM_HASHES = 26, 4
NO_ID = -1  # stands for a null doc_id where documents are looked for
FIRST = "doc_id long, text_hash long, n long, k1 long, k2 long, sign binary, run int, chunk int, counts binary"
PACKED = "bucket int, tok binary, pos binary, each binary, k1 binary, k2 binary, n binary"
PAIR = "kind int, tok long, a1 long, a2 long, an long, ai long, b1 long, b2 long, bn long, bi long"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    known: dict[bytes, int] = {}
    ids, ends = [], [0]
    for t in texts:
        w = lower_words(t)
        ids.extend([known.setdefault(x, len(known)) for x in w])
        ends.append(len(ids))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    n = len(h)
    with np.errstate(over="ignore"):
        run = np.zeros(n, np.uint64)
        for k in range(size):
            run[: max(0, n - k)] = mixed(run[: max(0, n - k)] * _MIX[0] + h[k:]) if n > k else run[:0]
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a >= size:
                s = np.sort(run[a : b - size + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = mixed(np.array([whole * _MIX[0] + x], np.uint64))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signature(s: np.ndarray) -> bytes:
    """Parities of how many members fall on each of about 2 n bits. Members that two sets share cancel, so the bits that differ are at most the members that do."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures by number, read where Arrow holds them; null where one is not known."""

    def __init__(self, signs: pa.Array | pa.ChunkedArray):
        chunks = signs.chunks if isinstance(signs, pa.ChunkedArray) else [signs]
        signs = pa.chunked_array([x.cast(pa.large_binary()) for x in chunks], pa.large_binary()).combine_chunks()
        end = np.frombuffer(signs.buffers()[1], "<i8")[signs.offset : signs.offset + len(signs) + 1] // 8 if len(signs) else np.zeros(1, np.int64)
        self.at, self.words = end[:-1], np.diff(end)
        self.flat = np.frombuffer(signs.buffers()[2], "<u8", end[-1]) if end[-1] else np.zeros(0, "<u8")

    def rows(self, who: np.ndarray, size: int) -> np.ndarray:
        """Signatures of size words, those of twice the size folded."""
        m, at = np.lib.stride_tricks.sliding_window_view(self.flat, size), self.at[who]
        out, wide = m[at], self.words[who] > size
        out[wide] ^= m[at[wide] + size]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Members at least that sets i and j don't share."""
        out, low, high = np.zeros(len(i), np.int64), np.minimum(self.words[i], self.words[j]), np.maximum(self.words[i], self.words[j])
        for size in np.unique(low[low > 0]):
            at = np.flatnonzero((low == size) & (high <= 2 * size))
            for x in np.array_split(at, -(-len(at) * int(size) // step)) if len(at) else ():
                out[x] = np.bitwise_count(self.rows(i[x], int(size)) ^ self.rows(j[x], int(size))).sum(1, dtype=np.int64)
        return out

    def allow(self, i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray) -> np.ndarray:
        """False only where sets i and j, of ni and nj members, differ in too many members to be linked."""
        return self.apart(i, j) <= ni + nj - 2 * need(ni, nj)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of each document's set, and at the end the task's part of the count sketch."""
    run = TaskContext.get().partitionId()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    shift = np.uint64(64 - SKETCH_BITS)
    for b in small(batches, 1000, 4 << 20):
        sets = shingle_sets(raw(b.column("text")))
        if sets:
            sketch += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        keys = [_key(s) for s in sets]
        m = b.num_rows
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "n": pa.array([len(s) for s in sets], pa.int64()), "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
            "sign": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), "run": pa.array([run] * m, pa.int32()), "chunk": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary()),
        })
    parts = [(i, sketch[i << CHUNK_BITS : (i + 1) << CHUNK_BITS]) for i in range(1 << (SKETCH_BITS - CHUNK_BITS))]
    parts = [(i, p.tobytes()) for i, p in parts if p.any()]
    m = len(parts)
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_pydict({"doc_id": none, "text_hash": none, "n": none, "k1": none, "k2": none, "sign": pa.nulls(m, pa.binary()), "run": pa.array([run] * m, pa.int32()), "chunk": pa.array([i for i, _ in parts], pa.int32()), "counts": pa.array([p for _, p in parts], pa.binary())})


def _added(counts: list[bytes]) -> bytes:
    return np.minimum(np.sum([np.frombuffer(x, "<u4") for x in counts], 0, dtype=np.uint64), 0xFFFFFFFF).astype("<u4").tobytes()


def _postings(sketch, buckets: int):
    """Packed prefixes of the distinct sets of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, shift = np.frombuffer(sketch.value, "<u4"), np.uint64(64 - SKETCH_BITS)
        seen: set[tuple[int, int]] = set()
        toks, poss, owns, keys, sizes, held = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not toks:
                return
            tok, pos, own = np.concatenate(toks), np.concatenate(poss), np.concatenate(owns)
            n, k1, k2 = np.array(sizes, "<i4"), np.array([k[0] for k in keys], "<i8"), np.array([k[1] for k in keys], "<i8")
            bucket = ((tok >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tok, pos, own, bucket = tok[order], pos[order], own[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for i in range(buckets):
                a, b = cut[i], cut[i + 1]
                if a < b:
                    who, each = np.unique(own[a:b], return_counts=True)  # ascending, as the entries are
                    at = pos[a:b].astype("<u2" if pos[a:b].max() < 1 << 16 else "<u4")
                    rows.append((i, tok[a:b].astype("<u4").tobytes(), at.tobytes(), each.astype("<u4").tobytes(), k1[who].tobytes(), k2[who].tobytes(), n[who].tobytes()))
            names = [f.split()[0] for f in PACKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "bucket" else pa.binary()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names)
            for x in (toks, poss, owns, keys, sizes):
                x.clear()

        for b in small(batches, 1000, 4 << 20):
            for s in shingle_sets(raw(b.column("text"))):
                if not len(s) or (k := _key(s)) in seen:
                    continue
                seen.add(k)
                n = len(s)
                p = n - -(-NUM * n // DEN) + 1
                by = np.lexsort((s, count[(s >> shift).astype(np.int64)]))[:p]
                toks.append(s[by])
                poss.append(np.arange(p, dtype=np.uint32))
                owns.append(np.full(p, len(keys), np.uint32))
                keys.append(k)
                sizes.append(n)
                held += p
            if held > 1_000_000:
                yield from flush()
                held = 0
        yield from flush()

    return work


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of a and b members: DEN * i >= NUM * (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def may_link(an, ai, bn, bi):
    """Size and position tests for a member at positions ai and bi of sets of an and bn members."""
    return (NUM * np.maximum(an, bn) <= DEN * np.minimum(an, bn)) & (np.minimum(an - ai, bn - bi) >= need(an, bn))


def _lists(t: pa.Table) -> pa.Table:
    """Lists of one bucket: star pairs with the pivot (kind 0) and the entries of lists of three sets or more (kind 1)."""
    tok, pos, own, k1, k2, n, base = [], [], [], [], [], [], 0
    for r in t.to_pylist():
        # 32 bits of a member tell a bucket's members apart; where they don't, two lists are one, which only adds candidates.
        tok.append(np.frombuffer(r["tok"], "<u4").astype(np.uint64) | np.uint64(r["bucket"]) << np.uint64(32))
        pos.append(np.frombuffer(r["pos"], "<u2" if len(r["pos"]) < len(r["tok"]) else "<u4").astype(np.int64))
        each = np.frombuffer(r["each"], "<u4").astype(np.int64)
        own.append(np.repeat(np.arange(len(each)), each) + base)
        k1.append(np.frombuffer(r["k1"], "<i8"))
        k2.append(np.frombuffer(r["k2"], "<i8"))
        n.append(np.frombuffer(r["n"], "<i4").astype(np.int64))
        base += len(n[-1])
    tok, pos, own, k1, k2, n = map(np.concatenate, (tok, pos, own, k1, k2, n))
    # One number a set, though it may come from several tasks.
    order = np.lexsort((k2, k1))
    new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    k1, k2, n = k1[order][new], k2[order][new], n[order][new]
    # Members that only one entry holds link nothing.
    order = np.argsort(tok, kind="stable")
    tok, pos, own = tok[order], pos[order], number[own[order]]
    same = tok[1:] == tok[:-1]
    more = np.r_[False, same] | np.r_[same, False]
    tok, pos, own = tok[more], pos[more], own[more]
    order = np.lexsort((pos, own, tok))
    tok, pos, own = tok[order], pos[order], own[order]
    keep = np.r_[True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])] if len(tok) else np.zeros(0, bool)
    tok, pos, own = tok[keep], pos[keep], own[keep]
    start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(tok)])
    # The pivot is the set of least key: entries of a list are in key order, so its first.
    first = np.repeat(start, size)
    i = np.arange(len(tok))
    star = (i != first) & may_link(n[own[first]], pos[first], n[own], pos)
    a, b = own[first[star]], own[star]
    pair = np.unique(a * np.int64(len(n) + 1) + b) if len(a) else np.zeros(0, np.int64)
    a, b = pair // (len(n) + 1), pair % (len(n) + 1)
    zero = np.zeros(len(a), np.int64)
    rest = np.flatnonzero(np.repeat(size, size) >= 3)
    p, x = own[first[rest]], own[rest]
    col = lambda u, v: pa.array(np.r_[u, v].astype(np.int64))
    return pa.table({
        "kind": pa.array(np.r_[zero, np.ones(len(rest), np.int64)].astype(np.int32)), "tok": pa.array(np.r_[zero.astype(np.uint64), tok[rest]].view(np.int64)),
        "a1": col(k1[a], k1[p]), "a2": col(k2[a], k2[p]), "an": col(n[a], n[p]), "ai": col(zero, pos[first[rest]]), "b1": col(k1[b], k1[x]), "b2": col(k2[b], k2[x]), "bn": col(n[b], n[x]), "bi": col(zero, pos[rest]),
    })


def _settled(i, j, n, sure):
    """Whether the pivot's answers rule a pair out: |x & y| <= |p & y| + |x| - |x & p|, and with x and y exchanged."""
    known = (sure[i] >= 0) & (sure[j] >= 0)
    return known & (np.minimum(sure[j] + n[i] - sure[i], sure[i] + n[j] - sure[j]) < need(n[i], n[j]))


def _nearest(t: pa.Table, signs: pa.Table) -> pa.Table:
    """Of a bucket's pairs only those that are the nearest, by their signatures, of one of their sets."""
    found = _block_pairs(t, signs)
    if not found.num_rows:
        return found
    a, b = (found.column(c).to_numpy() for c in "ab")
    known = signs.column("own").to_numpy()
    by_id = np.argsort(known)
    at = [by_id[np.searchsorted(known, x, sorter=by_id)] for x in (a, b)]
    apart = Signatures(signs.column("sign")).apart(*at)
    best = np.zeros(len(a), bool)
    for x in at:
        order = np.lexsort((apart, x))
        best[order[np.r_[True, x[order][1:] != x[order][:-1]]]] = True
    return found.filter(pa.array(best))


def _block_pairs(t: pa.Table, signs: pa.Table) -> pa.Table:
    """Pairs of different classes within the lists of a bucket, by blocks of size and, in them, of position; pairs that the pivot's answers or the signatures settle are left out."""
    known = signs.column("own").to_numpy()
    signatures, by_id = Signatures(signs.column("sign")), np.argsort(known)
    g = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("tok", "size_class", "id", "cls", "n", "pos", "sure", "part")}
    order = np.lexsort((g["pos"], g["n"], g["size_class"], g["tok"]))
    tok, size_class, ids, cls, n, pos, sure, part = (g[c][order] for c in ("tok", "size_class", "id", "cls", "n", "pos", "sure", "part"))
    rank = np.searchsorted(known, ids, sorter=by_id)
    edges = lambda: np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (size_class[1:] != size_class[:-1])]) if len(tok) else np.zeros(0, np.int64)
    # Lists that are all of one class by now are done.
    start = edges()
    mixed_list = np.repeat(np.minimum.reduceat(cls, start) < np.maximum.reduceat(cls, start), np.diff(np.r_[start, len(tok)]))
    tok, size_class, rank, cls, n, pos, sure, part = (x[mixed_list] for x in (tok, size_class, rank, cls, n, pos, sure, part))
    # Of a list's two parts only entries of different ones are compared here.
    apart = lambda i, j: (cls[i] != cls[j]) & ((part[i] < 0) | (part[i] != part[j]))
    who = by_id[rank]
    start = edges()
    stop = np.r_[start[1:], len(tok)] if len(tok) else start
    end = np.repeat(stop, stop - start)
    short = np.repeat(stop - start <= SHORT, stop - start)
    found, held = [], 0

    def add(i, j) -> None:
        """Keeps pairs by the ranks of their ids, each once, though many lists have them."""
        nonlocal found, held
        found.append(np.minimum(rank[i], rank[j]) * np.int64(len(known)) + np.maximum(rank[i], rank[j]))
        held += len(found[-1])
        if held > PAIRS_HELD + 2 * len(found[0]):
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])

    # Short lists, all at once: each entry with the next, the next but one, and so on while sizes may still link.
    i = np.flatnonzero(short)
    for step in range(1, SHORT):
        i = i[i + step < end[i]]
        i = i[NUM * n[i + step] <= DEN * n[i]]  # sizes ascend, so no later entry can link either
        if not len(i):
            break
        j = i + step
        take = np.flatnonzero(apart(i, j) & may_link(n[i], pos[i], n[j], pos[j]) & ~_settled(i, j, n, sure))
        take = take[signatures.allow(who[i[take]], who[j[take]], n[i[take]], n[j[take]])]
        add(i[take], j[take])
    for a, b in zip(start, stop, strict=True):
        if b - a <= SHORT:
            continue
        block = np.flatnonzero(np.r_[True, n[a + 1 : b] != n[a : b - 1]]) + a  # one block a set size, ordered by position
        edge, sizes = np.r_[block[1:], b], n[block]
        for i in range(a, b):
            lo, hi = np.searchsorted(sizes, n[i]), np.searchsorted(sizes, DEN * n[i] // NUM, "right")
            for k in range(lo, hi):
                least = int(need(n[i], sizes[k]))
                if n[i] - pos[i] < least:
                    break  # larger sets need still more
                upto = block[k] + np.searchsorted(pos[block[k] : edge[k]], sizes[k] - least, "right")  # the rest of the block is skipped
                j = np.arange(max(block[k], i + 1) if k == lo else block[k], upto)
                j = j[apart(np.full(len(j), i), j)]
                j = j[~_settled(np.full(len(j), i), j, n, sure)]
                j = j[signatures.allow(np.full(len(j), who[i]), who[j], np.full(len(j), n[i]), n[j])]
                if len(j):
                    add(np.full(len(j), i), j)
    pair = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return pa.table({c: pa.array(known[by_id[x]].astype(np.int64)) for c, x in zip("ab", np.divmod(pair, max(1, len(known))), strict=True)})


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their signatures allow."""
    for b in small(batches):
        m, signs = np.arange(b.num_rows), Signatures(pa.chunked_array([b.column("asign"), b.column("bsign")]))
        ok = signs.allow(m, m + b.num_rows, b.column("an").to_numpy(), b.column("bn").to_numpy())
        yield b.drop_columns(["asign", "bsign"]).filter(pa.array(ok))


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 500):
        got = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "an": b.column("an"), "bn": b.column("bn"), "both": pa.array(got, pa.int64())})


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(ids.astype(np.uint64) * _MIX[0] + np.uint64(1))
        return np.stack([((h >> np.uint64(32)) + np.uint64(k) * (h & np.uint64(0xFFFFFFFF) | np.uint64(1))) & np.uint64((1 << bits) - 1) for k in range(BLOOM_HASHES)])


def _bloom(ids: DataFrame, bits: int) -> bytes:
    """Bloom filter of the ids, of 2**bits bits, built in parts on the executors and united in a tree: at most 8 MB at the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << bits, bool)
        for b in batches:
            on[_places(b.column(0).to_numpy(), bits).ravel()] = True
        packed = np.packbits(on, bitorder="little").reshape(-1, 1 << max(0, bits - 3 - 6))
        at = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(at, pa.int32()), "run": pa.array([TaskContext.get().partitionId()] * len(at), pa.int32()), "counts": pa.array([packed[i].tobytes() for i in at], pa.binary())})

    union = lambda parts: np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in parts]).tobytes()
    out = bytearray(1 << max(0, bits - 3))
    for r in tree_sum(ids.mapInArrow(build, PARTS), union, ids.rdd.getNumPartitions()).collect():
        out[r.chunk * len(r.counts) : (r.chunk + 1) * len(r.counts)] = r.counts
    return bytes(out)


def _members(docs: DataFrame, wanted: DataFrame, name_of) -> DataFrame:
    """id, members of each wanted set (id, rep), rep being a document that has it. A Bloom filter of bounded size goes ahead, so that most texts are neither read into sets nor shuffled; where the documents outgrow it, it only lets more through. A document counts by its set's own key, as other texts may have its doc_id."""
    wanted = written(wanted.select("id", F.coalesce("rep", F.lit(NO_ID)).alias("rep")), "wanted")
    bits = min(BLOOM_BITS, max(12, (12 * wanted.count()).bit_length()))
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted.select("rep"), bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(bloom.value, np.uint8)
        for b in small(batches, 1000, 4 << 20):
            p = _places(b.column(0).fill_null(NO_ID).to_numpy(), bits).astype(np.int64)
            b = b.filter(pa.array(((on[p >> 3] >> (p & 7)) & 1).all(0).astype(bool)))
            s = shingle_sets(raw(b.column("text")))
            keys = [_key(x) for x in s]
            yield pa.RecordBatch.from_pydict({"k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()), "members": pa.array([x.tobytes() for x in s], pa.binary())})

    found = id_text(docs).mapInArrow(tidy(work), "k1 long, k2 long, members binary").withColumn("id", name_of("k1", "k2"))
    return found.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.first("members").alias("members"))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, name_of, name: str) -> DataFrame:
    """a, b, an, bn, both (exact intersection) of candidate pairs a, b of sets with sizes an, bn."""
    pairs = written(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(sets.select("id", "rep"), "id")
    members = written(_members(docs, wanted, name_of), f"{name}-sets")
    x, y = members.select(F.col("id").alias("a"), F.col("members").alias("x")), members.select(F.col("id").alias("b"), F.col("members").alias("y"))
    # b is the copy, a the pivot that many pairs share: each copy's set moves once, to where its pivot is.
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "an", "bn", "x", "y")
    answers = written(both.mapInArrow(tidy(_overlap), "a long, b long, an long, bn long, both long"), name)
    discard(members)
    return answers


def roots(up: DataFrame, rounds: int = 40) -> DataFrame:
    """id, cls of every node of a forest given as (id, up), cls being the least id of its tree: pointers are doubled until all reach a root."""
    n = up.count()
    at = checkpointed(up.select("id", "up"), n)
    for _ in range(rounds):
        nxt = checkpointed(at.join(at.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), n)
        at = nxt.select("id", "up")
        if not nxt.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("the forest is deeper than 2 ** rounds")
    tree = at.union(at.select(F.col("up").alias("id"), "up").distinct())
    least = tree.groupBy("up").agg(F.min("id").alias("cls"))
    return checkpointed(tree.join(least, "up").select("id", "cls"), n)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, cls (least id reachable) of every end of edges (a, b): each round all take the least label around them, then their label's label. Cut by reliable checkpoints; nothing is gathered on the driver but a count."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    n = both.count()
    label = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("cls")), n)
    for _ in range(rounds):
        around = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cls").alias("near"))
        step = label.join(around, "id").select("id", F.least("cls", "near").alias("to"), F.col("cls").alias("was"))
        hop = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = checkpointed(step.join(hop, "to", "left").select("id", F.least("to", "far").alias("cls"), "was"), n)
        label = step.select("id", "cls")
        if not step.where("cls <> was").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def _joined(cls: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, cls) after links (a, b) between classes; a document without a class is one of its own."""
    to = components(links.distinct())
    to = to.select(F.col("id").alias("cls"), F.col("cls").alias("to"))
    alone = to.join(cls.select("cls").distinct(), "cls", "left_anti").select(F.col("cls").alias("id"), F.col("to").alias("cls"))
    return checkpointed(cls.join(to, "cls", "left").select("id", F.coalesce("to", "cls").alias("cls")).union(alone))


def _named(keys: DataFrame) -> tuple[DataFrame, int]:
    """keys (k1, k2, ...) with a 64-bit id for each 128-bit key, no two of which are equal, and the salt of the ids."""
    for salt in range(64):
        ids = keys.withColumn("id", F.xxhash64("k1", "k2", F.lit(salt)))
        if ids.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
            return ids, salt
    raise RuntimeError("no salt tells all keys apart")


def ngram_join(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs, and text_hash (xxhash64 of the text), which tells rows of one doc_id apart; with links also n_links, the number of other rows that the row links to.

    Sets go by ids of their keys, so rows count by their texts whatever doc_ids they share or lack. Counting links verifies every candidate pair of different sets, as no class settles a count: it takes time with the square of a group of different near copies, where classes do not.
    """
    spark = docs.sparkSession
    first = written(id_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_first), FIRST), "shingle-keys")
    tasks = (first.agg(F.max("run")).first()[0] or 0) + 1
    sketch = np.zeros(1 << SKETCH_BITS, "<u4")  # 4 MB whatever the corpus
    for r in tree_sum(first.where("chunk is not null").select("chunk", "run", "counts"), _added, tasks).collect():
        sketch[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.counts, "<u4")
    rows = first.where("chunk is null").select("doc_id", "text_hash", "n", "k1", "k2", "run")
    part = first.where("n > 0").groupBy("k1", "k2", "run").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.count("*").alias("copies"))
    sets = written(part.groupBy("k1", "k2").agg(F.min("rep").alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.sum("copies").alias("copies")), "sets")
    sets, salt = _named(sets)
    name_of = lambda a, b: F.xxhash64(a, b, F.lit(salt))
    buckets = group_count(docs)
    packed = id_text(docs).mapInArrow(tidy(_postings(spark.sparkContext.broadcast(sketch.tobytes()), buckets)), PACKED)
    lists = written(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists, PAIR), "lists")
    lists = lists.select("kind", "tok", name_of("a1", "a2").alias("a"), "a1", "a2", "an", name_of("b1", "b2").alias("b"), "bn", "bi")
    stars = lists.where("kind = 0").select("a", "b", "an", "bn", "a1", "a2").distinct()
    signs = sets.select("id", "sign")
    sign = lambda k: signs.select(F.col("id").alias(k), F.col("sign").alias(f"{k}sign"))
    stars = stars.join(sign("b"), "b").join(sign("a"), "a").select("a", "b", "an", "bn", "a1", "a2", "asign", "bsign")
    stars = written(stars.mapInArrow(_likely, "a long, b long, an long, bn long, a1 long, a2 long"), "stars")
    # First each set with the least of its pivots. Links point to lesser keys, so they are a forest.
    one = stars.groupBy("b").agg(F.min_by(F.struct("a", "an", "bn"), F.struct("a1", "a2")).alias("p")).select("p.a", "b", "p.an", "p.bn")
    answers = _verified(one, sets, docs, name_of, "answers")
    linked = F.col("both") * DEN >= (F.col("an") + F.col("bn") - F.col("both")) * NUM
    cls = roots(answers.where(linked).select(F.col("b").alias("id"), F.col("a").alias("up")))
    class_of = lambda k, to: cls.select(F.col("id").alias(k), F.col("cls").alias(to))
    across = lambda df: df.join(class_of("a", "x"), "a", "left").join(class_of("b", "y"), "b", "left").withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})
    known = answers.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("both").alias("with_pivot"))
    size = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"{k}n"))
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    in_order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def spread(cls: DataFrame | None) -> tuple[DataFrame, object]:
        """Entries of the lists, by buckets, with what is known from the pivot, and the signatures of each bucket's sets; with classes only of lists whose entries are not all of one."""
        rest = lists.where("kind = 1").select("tok", F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("bn").alias("n"), F.col("bi").alias("pos"))
        rest = rest.join(cls, "id", "left").withColumn("cls", F.coalesce("cls", "id")) if cls else rest.withColumn("cls", F.col("id"))
        # A size class of each list and the next larger one meet: enough for every pair that may link, and what a task gets of a long list is bounded by its class.
        step = F.floor(F.log(F.col("n").cast("double")) / np.log(DEN / NUM) + 1e-9).cast("int")
        rest = written(rest.select("tok", "pivot", "id", "cls", "n", "pos", F.explode(F.array(step, step - 1)).alias("size_class")), "rest")
        # Lists of the same sets are scanned once, with each set's least position: the tests then let through whatever one of the lists would.
        same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"same{k}") for k in (1, 2)]
        open_ = rest.groupBy("tok", "size_class").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("m"), *same).where("x <> y").drop("x", "y")
        rest = rest.join(open_, ["tok", "size_class"]).groupBy("same1", "same2", "m", "size_class", "pivot", "id", "cls", "n").agg(F.min("pos").alias("pos")).withColumn("tok", F.col("same1"))
        rest = rest.join(known, ["pivot", "id"], "left")
        sure = F.when(F.col("id") == F.col("pivot"), F.col("n")).otherwise(F.coalesce("with_pivot", F.lit(-1))).cast("long")
        parts = F.ceil(F.col("m") / LIST_PART).cast("int")
        rest = rest.select("tok", "same2", "size_class", "id", "n", "pos", sure.alias("sure"), parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(5)), parts).alias("own"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        rest = rest.withColumn("tok", F.when(F.col("parts") == 1, F.col("tok")).otherwise(F.xxhash64("tok", "low", "high")))
        bucket = F.pmod(F.xxhash64("tok", "same2", "size_class"), F.lit(4 * buckets)).cast("int")
        part = F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("own"))
        entries = written(rest.select("tok", "size_class", "id", "n", "pos", "sure", part.alias("part"), bucket.alias("bucket")), "entries")
        theirs = entries.select("bucket", "id").distinct().join(signs, "id").select(F.col("bucket").alias("at"), F.col("id").alias("own"), "sign")
        return entries, written(theirs, "entry-signatures").groupBy("at")

    entries, theirs = spread(cls)

    def merged(method, others: DataFrame | None, name: str) -> bool:
        """Verifies the method's pairs of different classes, and others, and joins the classes that they link; whether there are any."""
        nonlocal cls, done
        now = entries.join(cls, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
        more = now.groupBy("bucket").cogroup(theirs).applyInArrow(method, "a long, b long")
        more = (more.union(others) if others else more).distinct().join(done, ["a", "b"], "left_anti")
        more = _verified(more.join(size("a"), "a").join(size("b"), "b"), sets, docs, name_of, name)
        found = across(more.where(linked)).select(F.col("x").alias("a"), F.col("y").alias("b"))
        done = done.union(more.select("a", "b"))
        if found.isEmpty():
            return False
        cls = _joined(cls, found)
        return True

    # Each set with the nearest set of another class, again while that joins classes; so few are left of what links to itself in many ways before all pairs are listed.
    for i in range(NEAREST_ROUNDS):
        if not merged(_nearest, None, f"nearest{i}"):
            break
    # All that is left, and the other pivots, where they are of another class: lists of two entries are nowhere else.
    merged(_block_pairs, in_order(across(stars).where("x <> y")), "more-answers")
    # Written ahead of the join, which so deals a class of very many sets anew.
    least = written(cls.join(sets.select("id", "rep"), "id").groupBy("cls").agg(F.min("rep").alias("least")), "least")
    of = sets.join(cls.join(least, "cls"), "id", "left").select("id", "k1", "k2", "copies", F.coalesce("least", "rep").alias("component_id"))
    if links:
        entries, theirs = spread(None)
        pairs = entries.withColumn("cls", F.col("id")).groupBy("bucket").cogroup(theirs).applyInArrow(_block_pairs, "a long, b long")
        pairs = pairs.union(in_order(stars)).distinct().join(size("a"), "a").join(size("b"), "b")
        pairs = _verified(pairs, sets, docs, name_of, "links").where(linked)
        copies = sets.select(F.col("id").alias("b"), "copies")
        beside = pairs.select("a", "b").union(pairs.select("b", "a")).join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("beside"))
        of = of.join(beside, "id", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("beside", F.lit(0)))
    more = ["component_id", *["n_links"] * links]
    of = part.select("k1", "k2", "run").join(of.select("k1", "k2", *more), ["k1", "k2"])
    out = rows.join(of, ["k1", "k2", "run"], "left")
    n_links = [F.coalesce("n_links", F.lit(0)).alias("n_links")] * links
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *n_links, "text_hash")


def op1(docs: DataFrame) -> DataFrame:
    return ngram_join(docs).drop("text_hash")
