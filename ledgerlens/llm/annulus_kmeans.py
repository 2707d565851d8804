"""Centroid clustering by annulus search.

Centroids are sorted by norm. By the triangle inequality a centroid within distance u of a vector has a norm within u of the vector's. For each vector the distance to the centroid of nearest norm is an upper bound u; binary search gives the stretch of centroids whose norms lie in the annulus, ties on its edge included, and only these are compared exactly, outwards from the vector's norm; the annulus narrows as nearer ones are found.

All arithmetic is on integers: components are floor(scale * x). While they are small enough, float64 holds every product and sum without rounding; beyond, Python's integers do. New centroids are exact floors of sums, which are added up in each task, then by cluster in a tree, as decimal numbers. Every round reads the table once and shuffles k sums a task; what the driver holds is k centroids and k sums.

Cases: vectors that are null, of another length, or that hold a null or non-finite component are left out; a null vec_id hashes as the text 'null'; repeated rows count each, and of equal hashes the lesser vector starts first; ties go to the centroid of smaller number; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows; a distance or inertia beyond a long counts as the largest long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, small, tree_sum, written
from .vectors import LONG, WHOLE, clipped, floored, largest, matrix, vectors

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2"
BATCH = 4096


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def norms(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared) if squared.dtype != object else np.array([float(math.isqrt(int(s))) for s in squared])


class Annulus:
    """Centroids by norm."""

    def __init__(self, centroids: list[list[int]]):
        self.most = max((abs(x) for c in centroids for x in c), default=0)
        rows = np.array(centroids, dtype=object)
        rows = rows.astype(np.float64) if self.most < WHOLE else rows
        n = norms(squares(rows))
        self.number = np.lexsort((np.arange(len(n)), n))
        self.rows, self.norm = rows[self.number], n[self.number]
        #: Exact comparisons made so far.
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance to it."""
        most = max(self.most, largest(x))
        rows = self.rows
        if 4 * x.shape[1] * most * most >= WHOLE:
            as_int = lambda m: m if m.dtype == object else np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)
            x, rows = as_int(x), as_int(rows)
        square = squares(x)
        norm = norms(square)
        # The centroid of nearest norm gives the first bound.
        above = np.minimum(np.searchsorted(self.norm, norm), len(rows) - 1)
        below = np.maximum(above - 1, 0)
        probe = np.where(np.abs(self.norm[below] - norm) <= np.abs(self.norm[above] - norm), below, above)
        best, number = squares(x - rows[probe]), self.number[probe]
        self.compared += len(x)
        slack = 2 + 1e-9 * norm  # beyond what rounding of norms can hide
        reach = norms(best) * (1 + 1e-9) + slack
        first, last = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        # Outwards from the probe, so that the annulus narrows early.
        for step in range(1, int(max((probe - first).max(), (last - 1 - probe).max())) + 1) if len(x) else ():
            for j in (probe - step, probe + step):
                at = np.flatnonzero((first <= j) & (j < last))
                at = at[np.abs(self.norm[j[at]] - norm[at]) <= reach[at]]
                if not len(at):
                    continue
                self.compared += len(at)
                c = j[at]
                apart = squares(x[at] - rows[c])
                won = ((apart < best[at]) | ((apart == best[at]) & (self.number[c] < number[at]))).astype(bool)
                at = at[won]
                best[at], number[at] = apart[won], self.number[c[won]]
                reach[at] = norms(best[at]) * (1 + 1e-9) + slack[at]
        return number, best


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in small(batches, BATCH):
        if b.num_rows:
            yield b.column("vec_id"), floored(matrix(b.column("v")), scale)


def _summing(centroids: list[list[int]], scale: int):
    """chunk: a centroid; counts: how many vectors it has in this task and the sums of their components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums = Annulus(centroids), {}
        for _, x in _blocks(batches, scale):
            number, _ = near.nearest(x)
            for c in np.unique(number):
                own = x[number == c]
                exact = own if largest(own) * len(own) < WHOLE else own.astype(object)
                row = [len(own), *(int(s) for s in exact.sum(axis=0))]
                sums[int(c)] = [a + b for a, b in zip(sums[int(c)], row, strict=True)] if int(c) in sums else row
        run = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([*sums], pa.int32()), "run": pa.array([run] * len(sums), pa.int32()), "counts": pa.array([" ".join(map(str, s)).encode() for s in sums.values()], pa.binary())})

    return work


def _added(parts: list[bytes]) -> bytes:
    return " ".join(str(sum(x)) for x in zip(*(map(int, p.split()) for p in parts), strict=True)).encode()


def _assigning(centroids: list[list[int]], scale: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for ids, x in _blocks(batches, scale):
            number, apart = near.nearest(x)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(number, pa.int32()), "distance": pa.array(clipped(apart))})

    return work


def fitted(rows: DataFrame, k: int, rounds: int, scale: int, seed: str) -> list[list[int]]:
    """The centroids after so many rounds. rows: vec_id, v."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    start = rows.withColumn("h", h).orderBy("h", "v").limit(k).collect()
    centroids = [[int(x) for x in floored(np.array([r.v]), scale)[0]] for r in start]
    tasks = rows.rdd.getNumPartitions() if centroids else 0
    for _ in range(rounds if centroids else 0):
        parts = rows.mapInArrow(_summing(centroids, scale), PARTS)
        for r in tree_sum(parts, _added, tasks).collect():  # one row a centroid
            n, *sums = map(int, r.counts.split())
            centroids[r.chunk] = [s // n for s in sums]
    return centroids


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of every vector that is kept, and the final centroids. Each round reads table again, so it should be a stored one."""
    rows = vectors(table, dim)
    centroids = fitted(rows, k, rounds, scale, seed)
    return rows.mapInArrow(_assigning(centroids, scale), "vec_id long, cluster int, distance long"), centroids


def op11(table: DataFrame) -> DataFrame:
    assigned, centroids = cluster(table)
    assigned = written(assigned, "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = [(i, min(LONG, sums.get(i, 0)), min(LONG, sum(sums.values())), sha(c)) for i, c in enumerate(centroids)]
    by = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle() -> str:
    """Plain Lloyd rounds over all pairs of vectors and centroids."""
    kept = f"len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    parts = [f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {kept})"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < {K})")
    far = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT vec_id, v, c, CAST({far} AS BIGINT) AS apart FROM v CROSS JOIN c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY apart, c) = 1)")
        if i < ROUNDS:
            sums = f"SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) AS r(i) GROUP BY c, i"
            means = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM ({sums}) GROUP BY c"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN ({means}) n USING (c))")
    last = f"SELECT vec_id, CAST(c AS INT) AS cluster, apart AS distance, CAST(sum(apart) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(apart) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"
    return f"WITH {', '.join(parts)} {last}"
