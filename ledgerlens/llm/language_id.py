"""Language identification by nearest centroid.

Texts become hashed byte n-grams (ASCII letters lower-cased, other ASCII characters a space), weighted by TF-IDF and normalised to length 1. Each language has up to CENTROIDS centroids, found by spherical k-means; a text takes the language of the centroid of greatest cosine, which is its score. A text whose cosine falls below its centroid's rejection bound (from the training sample's own distances) is marked rejected; its best language is still reported.
Document frequencies cover all training documents. The k-means fit takes at most SAMPLE distinct documents a language, those of least hash of doc_id and text. Their n-gram counts are made on the executors, so what reaches the driver is at most SAMPLE vectors of DIMS counts a language, however long their texts are, and one row a dimension and a language.

Cases: null text and texts without a letter are 'und' with score 0; null lang is not learnt from; of equal cosines the language that comes first by name wins, and of its centroids the first; repeated rows count each in the frequencies and once in the sample; without training documents everything is 'und'; an empty table gives no rows; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, raw, small

DIMS = 4096
ORDERS = (2, 3)
CENTROIDS = 4
SAMPLE = 300
ROUNDS = 12
REJECT_QUANTILE, REJECT_SLACK = 0.01, 0.8
UNKNOWN = "und"
_TABLE = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams: a row a text. Runs of spaces count as one."""
    clean = [b" " + b" ".join(t.translate(_TABLE).split()) + b" " for t in texts]
    big = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    size = np.array([len(c) for c in clean])
    doc, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    out = np.zeros(len(texts) * dims, np.float32)
    for k in ORDERS:
        n = len(big) - k + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint32)
        for i in range(k):
            code = code * np.uint32(257) + big[i : i + n]
        code = (code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - dims.bit_length() + 1)
        inside = np.arange(n) + k <= end[:n]
        out += np.bincount((doc[:n] * dims + code)[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), dims)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def centroids(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centres, and each centre's rejection bound."""
    mean = x.mean(0)
    at = [int(np.argmax(x @ mean))]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(1))))
    c = x[at].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(1e-12, float(np.sqrt((m * m).sum())))
    s = x @ c.T
    near, best = np.argmax(s, 1), s.max(1)
    low = [float(np.quantile(best[near == j], REJECT_QUANTILE)) * REJECT_SLACK if (near == j).any() else 0.0 for j in range(len(c))]
    return c, np.array(low)


class Model:
    def __init__(self, langs: list[str], centres: np.ndarray, of: np.ndarray, low: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.of, self.low, self.idf = langs, centres, of, low, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        for i in range(0, len(at), 250):
            part = at[i : i + 250]
            s = vectors(features([texts[j].encode() for j in part]), self.idf) @ self.centres.T
            best = s.argmax(1)
            for j, b, v in zip(part, best, s.max(1), strict=True):
                lang[j], score[j], rejected[j] = self.langs[self.of[b]], min(1.0, max(0.0, float(v))), v < self.low[b]
        return lang, score, rejected


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), {}
    for b in small(batches, 250, 8 << 20):
        df += (features(raw(b.column("text"))) > 0).sum(0)
        for x in b.column("lang").to_pylist():
            n[x] = n.get(x, 0) + 1
    dims = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"lang": pa.array([None] * len(dims) + list(n), pa.string()), "dim": pa.array([*dims.tolist(), *[-1] * len(n)], pa.int32()), "n": pa.array([*df[dims].tolist(), *n.values()], pa.int64())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each text with a letter, as its dimensions and their counts."""
    for b in small(batches, 250, 8 << 20):
        b = b.filter(pa.array([bool(_LETTER.search(t)) for t in b.column("text").to_pylist()], pa.bool_()))
        x = features(raw(b.column("text")))
        dims = [np.flatnonzero(v) for v in x]
        yield pa.RecordBatch.from_pydict({"h": b.column("h"), "lang": b.column("lang"), "dims": pa.array([d.astype("<u2").tobytes() for d in dims], pa.binary()), "counts": pa.array([v[d].astype("<f4").tobytes() for v, d in zip(x, dims, strict=True)], pa.binary())})


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """train: doc_id, text, lang. Sums one row a dimension and a language over all of it; then fits on the sample."""
    train = train.where("lang is not null and text is not null")
    sums = train.select("text", "lang").mapInArrow(_frequencies, "lang string, dim int, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n")).collect()
    counts = {r.lang: r.n for r in sums if r.dim < 0}
    if not counts:
        return Model([], np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0), np.zeros(DIMS))
    df = np.zeros(DIMS)
    for r in sums:
        if r.dim >= 0:
            df[r.dim] = r.n
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 1).astype(np.float32)
    # A hash below a language's share keeps about twice the sample; the least hashes of these are the sample.
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 40) * min(1.0, (2 * sample + 50) / n)))])
    rows = train.select(h.alias("h"), "lang", "text").where(F.col("h") < share[F.col("lang")]).mapInArrow(_vectors, "h long, lang string, dims binary, counts binary").dropDuplicates(["lang", "h"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample).collect()
    langs, centres, of, low = sorted(counts), [], [], []
    for i, lang in enumerate(langs):
        mine = sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)
        if mine:
            x = np.zeros((len(mine), DIMS), np.float32)
            for j, r in enumerate(mine):
                x[j, np.frombuffer(r.dims, "<u2")] = np.frombuffer(r.counts, "<f4")
            c, bound = centroids(vectors(x, idf))
            centres.append(c)
            low.append(bound)
            of += [i] * len(c)
    if not centres:
        return Model([], np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0), idf)
    return Model(langs, np.concatenate(centres).astype(np.float32), np.array(of), np.concatenate(low), idf)


def language_id(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; learns from the rows where held_out is false."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where("not held_out")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lang, score, rejected = model.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)})

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op2(docs: DataFrame) -> DataFrame:
    return language_id(docs, crc_mod(4) == 2)
