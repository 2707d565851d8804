"""Stored indexes for retrieval: an inverted index with block maxima, and vectors in clusters with centre and radius. Both leave out what cannot reach the best k, so results are those of a full scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens
from ..sources.scratch import cleaned, discard, written

#: Folders that words are dealt to; texts in a block; blocks that are scored first.
FOLDERS, BLOCK_TEXTS, FIRST_BLOCKS = 64, 512, 4
#: Blocks of a folder's words that one task groups and one file holds.
FILE_BLOCKS = 256
#: Scores are rounded to nine digits, cosines to six.
SLACK, COSINE_SLACK = 2e-9, 2e-6
MOST_CENTRES = 1024


def part(tf: Column, length: Column, n_texts: Column, total: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length * n_texts / total))


def write_lexical(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75) -> None:
    """The inverted index of docs (doc_id, text), below path: stats, one row of sums; words, how many texts have each; postings, by folders of words, a row a word and block of at most some BLOCK_TEXTS texts with the greatest share of a score that the word gives a text of it. A word that all texts hold is as many rows as there are blocks."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("text_no"), retrieval_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    rows = rows.select("doc_id", "text_no", F.size("w").cast("long").alias("len"), "w")
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, text_no long, len long, word string, tf long, head boolean"
    found = written(rows.mapInArrow(_counted, kinds), "terms")
    with cleaned(spark):
        found.where("head").agg(F.count("*").alias("n_docs"), F.sum("len").alias("total")).write.parquet(f"{path}/stats")
        found.where("word is not null").groupBy("word").agg(F.count("*").alias("df")).repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/words")
        n, total = spark.read.parquet(f"{path}/stats").first()
        blocks = max(1, -(-n // BLOCK_TEXTS))
        block = F.pmod(F.xxhash64("text_no"), F.lit(blocks)).cast("int")
        share = part(F.col("tf"), F.col("len"), F.lit(n), F.lit(max(1, total or 0)), k1, b)
        # Terms are shuffled once, by folder and a part of the blocks, which is also how they are grouped and written.
        dealt = found.where("word is not null").select(folder(F.col("word")).alias("folder"), F.pmod(block, F.lit(-(-blocks // FILE_BLOCKS))).alias("file"), "word", block.alias("block"), "text_no", "doc_id", "tf", "len").repartition("folder", "file")
        by = dealt.groupBy("folder", "file", "word", "block").agg(F.max(share).alias("top"), F.collect_list(F.struct("text_no", "doc_id", "tf", "len")).alias("texts"))
        by.select("word", "block", "top", "texts", "folder").sortWithinPartitions("folder", "word", "block").write.partitionBy("folder").parquet(f"{path}/postings")
    discard(found)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word of each text with how often it is there; head: whether it is the text's first row. A text without words is one row without a word."""
    for batch in batches:
        at, word, tf, head = [], [], [], []
        for i, w in enumerate(batch.column("w")):
            counts = Counter(w.as_py()) or {None: 0}
            at += [i] * len(counts)
            word += counts.keys()
            tf += counts.values()
            head += [True, *[False] * (len(counts) - 1)]
        own = batch.select(["doc_id", "text_no", "len"]).take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(word, pa.string()), pa.array(tf, pa.int64()), pa.array(head, pa.bool_())], names=["doc_id", "text_no", "len", "word", "tf", "head"])


def folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDERS)).cast("int")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The postings of some words: only their folders are listed and read, and of these only the row groups that may hold them."""
    told = spark.createDataFrame([(w,) for w in words], "word string").select(folder(F.col("word")).alias("f")).distinct().collect()
    there = spark.read.option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/folder={r.f}" for r in told])
    return there.where(F.col("word").isin(words))


def search_lexical(spark: SparkSession, path: str, words: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id, score: what retrieval.bm25 gives, from the index. Blocks are bounded by the sum of their words' greatest shares; some are scored first, and then only those whose bound reaches the k-th score so far. k1 and b are those that the index was written with."""
    query = Counter(words)
    empty = spark.createDataFrame([], "doc_id long, score double")
    n, total = spark.read.parquet(f"{path}/stats").first()
    known = {r.word: r.df for r in spark.read.parquet(f"{path}/words").where(F.col("word").isin([*query])).collect()}
    if not known:
        return empty
    weight = {w: query[w] * F.log(1 + (F.lit(n) - F.lit(df) + 0.5) / (F.lit(df) + 0.5)) for w, df in known.items()}
    told = spark.range(1).select(F.explode(F.create_map(*[x for w in sorted(weight) for x in (F.lit(w), weight[w])])).alias("word", "weight"))
    held = postings(spark, path, sorted(known)).join(F.broadcast(told), "word")  # a row a word of the query
    bounds = held.groupBy("block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        each = held.join(blocks, "block", "left_semi").select("word", "weight", F.inline("texts"))
        gain = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") * F.lit(n) / F.lit(total)))
        by = each.groupBy("text_no", "doc_id").agg(F.array_sort(F.collect_list(F.struct("word", gain.alias("gain")))).alias("gains"))  # words of the query at most
        return by.select("doc_id", F.round(F.aggregate("gains", F.lit(0.0), lambda s, x: s + x["gain"]), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

    first = scored(bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)).collect()
    least = min(r.score for r in first) - SLACK if len(first) == k else -1.0
    return scored(bounds.where(F.col("bound") >= least))


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column("embedding").to_pylist(), np.float64)
            n = np.sqrt((x * x).sum(axis=1))
            yield batch, x / np.where(n > 0, n, 1)[:, None]


def _placing(centres: np.ndarray):
    """The nearest centre of each vector and the distance to it, both of length one. Centres cross over in the function that is sent to the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _normal(batches):
            apart = np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T)
            at = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(at, pa.int32()), pa.array(np.sqrt(apart[np.arange(len(x)), at]))], names=["vec_id", "embedding", "cluster", "apart"])

    return work


def write_vectors(vectors: DataFrame, path: str, centres: int | None = None) -> None:
    """Vectors (vec_id, embedding, all of one length) in clusters, below path: rows, a folder a cluster; clusters, each one's centre, radius and size. Centres are the vectors of least hash, some root of their number, MOST_CENTRES at most: any choice gives right results, a good one reads less."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = rows.count()
    k = max(1, min(MOST_CENTRES, centres or round(n**0.5)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()
    if not chosen:
        return
    points = np.array([r.embedding for r in chosen], np.float64)
    lengths = np.sqrt((points * points).sum(axis=1))
    points = np.unique(points / np.where(lengths > 0, lengths, 1)[:, None], axis=0)
    placed = rows.mapInArrow(_placing(points), "vec_id long, embedding array<double>, cluster int, apart double")
    placed.repartition("cluster").write.partitionBy("cluster").parquet(f"{path}/rows")
    by = vectors.sparkSession.read.parquet(f"{path}/rows").groupBy("cluster").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
    centre = vectors.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cluster int, centre array<double>")
    by.join(centre, "cluster").coalesce(1).write.parquet(f"{path}/clusters")  # MOST_CENTRES rows at most


def search_vectors(spark: SparkSession, path: str, query: list[float], k: int) -> tuple[DataFrame, float]:
    """vec_id, score: what retrieval.cosine gives, from the clusters, and the share of clusters read. With d the distance of query and centre, both of length one, nothing in a cluster is nearer than d - radius, so no cosine there is above 1 - (d - radius)**2 / 2. Clusters are read in order of that bound until k vectors are there, and then those whose bound reaches the k-th of these."""
    from .retrieval import cosine

    q = np.array(query, np.float64)
    size = float(np.sqrt(q @ q))
    clusters = spark.read.parquet(f"{path}/clusters").collect()
    bound = {}
    for c in clusters:
        gap = max(0.0, float(np.sqrt(((q / (size or 1) - np.array(c.centre)) ** 2).sum())) - c.radius - 1e-9)
        bound[c.cluster] = 1 - gap * gap / 2 if size and any(c.centre) else 1.0
    order, rows = sorted(clusters, key=lambda c: (-bound[c.cluster], c.cluster)), 0
    read = lambda some: spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/cluster={c}" for c in some]).select("vec_id", "embedding")
    first = []
    for c in order:
        if rows >= k:
            break
        first.append(c.cluster)
        rows += c.n
    found = cosine(read(first), query, k).collect()
    least = min(r.score for r in found) - COSINE_SLACK if len(found) == k else -2.0
    chosen = [c.cluster for c in order if c.cluster in first or bound[c.cluster] >= least]
    return cosine(read(chosen), query, k), len(chosen) / len(order)
