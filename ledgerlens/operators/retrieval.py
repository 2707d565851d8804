"""Lexical and vector retrieval."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens


def _is(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, words: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k texts of greatest BM25 score for the words of a query, each as often as it is in it. docs: doc_id, text. One pass keeps length and the counts of the query's words only."""
    tokens = docs.select("doc_id", retrieval_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    query = sorted(Counter(words).items())
    tf = [F.size(F.filter("w", _is(q))).alias(f"t{i}") for i, (q, _) in enumerate(query)]
    rows = tokens.select("doc_id", F.size("w").alias("len"), *tf)
    stats = rows.agg(F.count("*").alias("n_docs"), F.sum("len").alias("total"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(query))])
    x = rows.where(" or ".join(f"t{i} > 0" for i in range(len(query))) or "false").crossJoin(F.broadcast(stats))  # one row of sums
    score = F.lit(0.0)
    for i, (_, times) in enumerate(query):
        idf = F.log(1 + (F.col("n_docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + times * idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("len") * F.col("n_docs") / F.col("total")))
    return x.select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def cosine(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of greatest cosine with the query. vectors: vec_id, embedding."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding")
    norm = F.sqrt(dot(e, e)) * F.sqrt(dot(q, q))
    return vectors.select("vec_id", F.round(F.when(norm > 0, dot(e, q) / norm).otherwise(0.0), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def fuse(lists: list[DataFrame], top: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists (id, score): the top of each gives 1 / (constant + rank)."""
    parts = None
    for df in lists:
        ranked = df.orderBy(F.desc("score"), "id").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top).select("id", (1 / (constant + F.col("rank"))).alias("part"))
        parts = ranked if parts is None else parts.union(ranked)
    return parts.groupBy("id").agg(F.round(F.sum("part"), 12).alias("score"))
