"""Exact top-k by inner product, pruned a block of documents at a time.

Blocks are ranges of rows as the table stores them. A block has its forward index (its vectors) and, for each component, the largest and the least value in it: the maxima of a positive and of a negative query term. For a query the maxima times its terms, summed, bound every score in a block. Blocks are met in descending order of that bound, scored through their forward index, and a query is done when the next bound falls below its k-th score.

Queries are dealt to groups of QUERY_ROWS and blocks to groups of CELL_BLOCKS, so a task holds one group of each, and every pair of groups is a task; what is sent grows with queries * rows / group. A query brings a first k-th score along: that within its own block. Each task returns at most k rows a query, of which the best k stay.

Scores are integers: components are floor(scale * x), exact in float64 while sums of products stay below 2**53 and in Python's integers beyond. Ties go to the smaller vec_id.

Cases: vectors that are null or hold a null or non-finite component take no part; of vectors of different lengths the shorter counts as ending in zeros; a row with a null vec_id is no query, and as a candidate comes last among ties; repeated rows are candidates each, only the query's own row is not, and a query that is repeated is answered as often; an empty table gives no rows; scores beyond a long count as the largest or least; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, small, written
from .vectors import LONG, WHOLE, clipped, floored, largest, matrix, vectors

K, SCALE, EVERY = 10, 1024, 100
BLOCK_ROWS, CELL_BLOCKS, QUERY_ROWS = 256, 256, 16384
NOTHING = -LONG
INDEX = "block long, n int, ids array<long>, narrow boolean, forward binary, top binary, low binary"
QUERIES = "q_block long, q_pos int, query_id long, v binary, seed long"
FOUND = "q_block long, q_pos int, query_id long, vec_id long, score long"


def _indexing(scale: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in small(batches, rows):
            if not b.num_rows:
                continue
            x = floored(matrix(b.column("v")), scale)
            if x.dtype == object:
                x = x.astype(np.float64)  # floors of doubles from 2**53 on are doubles themselves
            narrow = largest(x) < 1 << 24
            yield pa.RecordBatch.from_pydict({
                "block": [block], "n": pa.array([len(x)], pa.int32()), "ids": pa.array([b.column("vec_id").to_pylist()], pa.list_(pa.int64())), "narrow": [narrow],
                "forward": [x.astype("<f4" if narrow else "<f8").tobytes()], "top": [x.max(axis=0).astype("<f8").tobytes()], "low": [x.min(axis=0).astype("<f8").tobytes()],
            })
            block += 1

    return work


def index(table: DataFrame, scale: int = SCALE, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block: its ids, forward index and the largest and least value of each component."""
    return vectors(table).mapInArrow(_indexing(scale, rows), INDEX)


class Block:
    def __init__(self, row: dict):
        self.block, self.null = row["block"], np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([LONG if i is None else i for i in row["ids"]], np.int64)
        self.rows = np.frombuffer(row["forward"], "<f4" if row["narrow"] else "<f8").astype(np.float64).reshape(row["n"], -1)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs; the shorter side ends in zeros."""
    d = min(queries.shape[1], rows.shape[1])
    q, x = queries[:, :d], rows[:, :d]
    if d * largest(q) * largest(x) < WHOLE:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)
    return clipped(np.dot(whole(q), whole(x).T), LONG - 1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _querying(every: int, k: int):
    """The rows of a block that are queries, each with its k-th score within the block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                block = Block(row)
                at = np.flatnonzero((block.ids % every == 0) & ~block.null)
                if not len(at):
                    continue
                s = scores(block.rows[at], block.rows)
                s[np.arange(len(at)), at] = NOTHING
                seeds = np.sort(s, axis=1)[:, -k].tolist() if s.shape[1] > k else [None] * len(at)
                out += [(block.block, int(p), int(block.ids[p]), block.rows[p].tobytes(), seed) for p, seed in zip(at, seeds, strict=True)]
            cols = [*zip(*out, strict=True)] if out else [[] for _ in range(5)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["q_block", "q_pos", "query_id", "v", "seed"])

    return work


def padded(rows: list[bytes]) -> np.ndarray:
    each = [np.frombuffer(r, "<f8") for r in rows]
    out = np.zeros((len(each), max((len(e) for e in each), default=0)))
    for i, e in enumerate(each):
        out[i, : len(e)] = e
    return out


def search(queries: np.ndarray, seeds: np.ndarray, own: list[tuple[int, int]], blocks: list[Block], top: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's best k among the blocks, and how many blocks were scored for a query. own: block and place of each query's own row."""
    d = max(queries.shape[1], top.shape[1])
    q, top, low = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (queries, top, low))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
        bound = np.nan_to_num(bound, nan=np.inf, posinf=np.inf) + 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T)  # beyond what rounding can hide
    order = np.argsort(-bound, axis=1, kind="stable")
    score, ids = np.full((len(q), k), NOTHING, np.int64), np.full((len(q), k), LONG, np.int64)
    kth, left, met = seeds.copy(), np.arange(len(q)), 0
    for turn in range(len(blocks)):
        at = order[left, turn]
        go = bound[left, at] >= kth[left]
        left, at = left[go], at[go]
        if not len(left):
            break
        met += len(left)
        by = np.argsort(at, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            block, rows = blocks[at[part[0]]], left[part]
            s = scores(queries[rows], block.rows)
            for i, r in enumerate(rows):
                if own[r][0] == block.block:
                    s[i, own[r][1]] = NOTHING
            worth = s.max(axis=1) >= kth[rows]
            rows, s = rows[worth], s[worth]
            if not len(rows):
                continue
            score[rows], ids[rows] = best(np.hstack([score[rows], s]), np.hstack([ids[rows], np.broadcast_to(block.ids, s.shape)]), k)
            kth[rows] = np.maximum(kth[rows], score[rows, -1])
    return score, ids, met


def _searching(k: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["q_block", "q_pos", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        own = [*zip(left.column("q_block").to_pylist(), left.column("q_pos").to_pylist(), strict=True)]
        seeds = np.array([NOTHING if s is None else s for s in left.column("seed").to_pylist()], np.int64)
        blocks = [Block(r) for r in right.select(["block", "n", "ids", "narrow", "forward"]).to_pylist()]
        score, ids, _ = search(padded(left.column("v").to_pylist()), seeds, own, blocks, padded(right.column("top").to_pylist()), padded(right.column("low").to_pylist()), k)
        i, j = np.nonzero((score > NOTHING) & (score >= seeds[:, None]))
        q = left.select(["q_block", "q_pos", "query_id"]).take(pa.array(i))
        null = ids[i, j] == LONG
        cols = [*(q.column(n).combine_chunks() for n in names[:3]), pa.array(ids[i, j], pa.int64(), mask=null), pa.array(score[i, j], pa.int64())]
        return pa.table(cols, names=names)

    return work


def exact_topk(table: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row whose vec_id is divisible by every."""
    blocks = written(index(table, scale), "index")
    queries = written(blocks.mapInArrow(_querying(every, k), QUERIES), "queries")
    n_blocks, n_queries, parts = blocks.count(), queries.count(), shuffle_parts(table.sparkSession)
    by_q = max(1, -(-n_queries // QUERY_ROWS))
    by_b = max(1, -(-n_blocks // CELL_BLOCKS), min(n_blocks, -(-parts // by_q)))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qg", dealt(by_q, "q_block", "q_pos")).withColumn("bg", each(by_b))
    right = blocks.withColumn("bg", dealt(by_b, "block")).withColumn("qg", each(by_q))
    found = left.groupBy("qg", "bg").cogroup(right.groupBy("qg", "bg")).applyInArrow(_searching(k), FOUND)
    order = Window.partitionBy("q_block", "q_pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13(table: DataFrame) -> DataFrame:
    return exact_topk(table)


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INT) AS rank,
       c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0 QUALIFY rank <= {K}
"""
