"""Retrieval: exact vector search, BM25, fusion and hybrid ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.latest import first_per, last_n
from docloom.operators.postings import QUERY_BLOCK, PostingIndex


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(norm(v) == 0, x).otherwise(x / norm(v)))


def vector_topk(points: DataFrame, query: list[float], k: int, threshold: float | None = None, vector: str = "dense") -> DataFrame:
    """The k points nearest to one query, exactly: a scan with a top-k, no join and no shuffle of vectors.

    A threshold of 0 or None filters nothing.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = points.withColumn("score", F.round(cosine(F.col(vector), q), 6))
    if threshold:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score) by BM25 Okapi over whitespace words, for documents that share a word with the query.

    docs: doc_id, text; queries: query_id, text. Negative inverse frequencies become epsilon times their mean. Document
    frequencies combine before their shuffle; term frequencies are counted for the words of queries only.
    """
    tokens = lambda c: F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda w: w != "")
    sized = docs.select("doc_id", F.size(tokens("text")).alias("dl"))
    asked = queries.select("query_id", F.explode(tokens("text")).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    wanted = asked.select("word").distinct()
    tf = docs.select("doc_id", F.explode(tokens("text")).alias("word")).join(wanted, "word", "left_semi").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(corpus))  # one row: two numbers
    idf = df.select("word", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    idf = idf.join(F.broadcast(mean)).select("word", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    hits = asked.join(idf, "word").join(tf, "word").join(sized, "doc_id")
    gain = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("score"))


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) places of each query's k best allowed items of a batch; ties go to smaller ids. scores: items x queries."""
    scores = np.where(allowed, scores, -np.inf)
    least = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    item, query = np.nonzero((scores >= least) & allowed)
    order = np.lexsort((ids[item], -scores[item, query], query))
    item, query = item[order], query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], item[keep]


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The rows of a stated set of queries, some at a time."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best of what bm25 gives, from posting lists and without the other pairs."""
    return PostingIndex.build(docs).topk(queries, k, k1, b, epsilon)


def _score_vectors(sent, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, q = sent.value
    for part in batches:
        x = np.stack(part["dense"].to_numpy()).astype(float)
        norm = np.sqrt((x * x).sum(axis=1))
        scores = np.round(np.where(norm[:, None] > 0, (x @ q.T) / np.where(norm > 0, norm, 1)[:, None], 0), 6)
        ids = part["id"].to_numpy()
        query, item = _best(scores, np.ones(scores.shape, bool), ids, k)
        yield pd.DataFrame({"query_id": names[query], "doc_id": ids[item], "score": scores[item, query]})


def vector_topk_each(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, score): the k points (id, dense) of largest cosine to each query (query_id, dense), exactly.

    Blocks of the stated queries go to all points; each batch keeps its k best. A zero vector's cosine is 0.
    """
    spark, shape, found = points.sparkSession, "query_id long, doc_id long, score double", None
    for block in _blocks(queries):
        q = np.array([r.dense for r in block], float)
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), q / np.where(norm > 0, norm, 1)))
        part = points.select("id", "dense").mapInPandas(partial(_score_vectors, sent, k), shape)
        found = part if found is None else found.unionByName(part)
    return top_per_query(spark.createDataFrame([], shape) if found is None else found, k).select("query_id", "doc_id", "rank", "score")


def top_per_query(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): the sum of 1 / (k + rank) over rankings (query_id, doc_id, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))


def dedup_prefix(hits: DataFrame, n: int = 100) -> DataFrame:
    """Of hits that begin with the same n characters, the best scored."""
    return first_per(hits, [F.substring("content", 1, n)], [F.desc("score"), F.col("id")])


__all__ = ["bm25", "bm25_topk", "cosine", "dedup_prefix", "dot", "last_n", "norm", "normalize", "reciprocal_rank_fusion", "top_per_query", "vector_topk", "vector_topk_each"]
