"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own k-means; a pair of centroids names a cell, and every
vector is filed under its cell. A query ranks the centroids of each half and walks the pairs by summed distance with a
heap until the cells it has seen hold the wanted share of entries. The entries of those cells are reranked by the exact
measure, the inner product in double precision.

k-means and the share are fitted on a bounded sample (about ``SAMPLE`` vectors, or 64 for each centroid if that is more):
the share is the least at which the sample's own exact neighbours are found with a recall of ``recall``. Centroids grow
with the square root of the entries, up to ``MOST_CENTROIDS`` a half. All vectors are indexed. Equal vectors are one entry
that carries the smallest of their ids, as many as an answer can hold, so a group of copies, however large, costs one entry.

Cells lie in blocks of some BLOCK_ENTRIES entries; a larger cell has several blocks. A query goes only to the blocks of the
cells that its walk reaches; where more than SLICE_QUERIES meet at a block, they are dealt to slices, each with its copy of
the block's entries. So what is shuffled follows the cells that are probed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import broadcast_small, stage

#: What meets in one task at most: about so many entries and so many queries.
BLOCK_ENTRIES, SLICE_QUERIES = 8_000, 2_000
SAMPLE, MOST_CENTROIDS = 8192, 256


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    norm = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norm - 2 * x[at : at + 4096] @ centres.T).argmin(axis=1)
    return out


class MultiIndex:
    """Two codebooks, the entries of each cell and the share of entries that a search looks at."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.cut = first.shape[1]
        self.sizes = np.zeros((len(first), len(second)), np.int64)
        self.share = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.first) * len(self.second) + nearest(x[:, self.cut :], self.second)

    def walk(self, query: np.ndarray, want: int) -> list[int]:
        """Non-empty cells by falling inner product of the query with their pair of centroids, until they hold want entries."""
        a, b = self.first @ query[: self.cut], self.second @ query[self.cut :]
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, pushed, out, held = [(-(a[i[0]] + b[j[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and held < want:
            _, p, q = heapq.heappop(heap)
            n = int(self.sizes[i[p], j[q]])
            if n:
                out.append(int(i[p]) * len(self.second) + int(j[q]))
                held += n
            for r, s in ((p + 1, q), (p, q + 1)):
                if r < len(i) and s < len(j) and (r, s) not in pushed:
                    pushed.add((r, s))
                    heapq.heappush(heap, (-(a[i[r]] + b[j[s]]), r, s))
        return out


def _calibrate(index: MultiIndex, x: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
    """The least share of entries at which the sample's queries find ``recall`` of their k exact neighbours."""
    cells = index.cells(x)
    index.sizes = np.bincount(cells, minlength=index.sizes.size).reshape(index.sizes.shape)
    needed = []
    for q in np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int):
        exact = x @ x[q]
        exact[q] = -np.inf
        best = np.argpartition(-exact, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        seen, held = {}, 0
        for c in index.walk(x[q], len(x)):
            held += int(index.sizes.flat[c])
            seen[c] = held / len(x)
        needed += [seen[c] for c in cells[best]]
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def fit(vectors: DataFrame, k: int, centroids: int | None = None, recall: float = 0.95) -> MultiIndex | None:
    """Codebooks and share from a bounded sample of distinct vectors, chosen by a hash of the vector (column v)."""
    n = vectors.count()
    if not n:
        return None
    centroids = centroids or int(min(MOST_CENTROIDS, max(16, (n / 50) ** 0.5)))
    share = max(SAMPLE, 64 * centroids) / n  # the vectors are distinct, so about so many come to the driver
    place = F.pmod(F.xxhash64("v", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    x = np.unique(np.array([r.v for r in vectors.where(place < share).select("v").collect()], np.float64), axis=0)
    cut = max(1, x.shape[1] // 2)
    index = MultiIndex(_kmeans(x[:, :cut], centroids), _kmeans(x[:, cut:], centroids) if x.shape[1] > 1 else np.zeros((1, 0)))
    index.share = _calibrate(index, x, k, recall)
    return index


def _file(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        if len(part):
            part["cell"] = sent.value.cells(np.stack(part["v"].to_numpy()).astype(np.float64))
            yield part[["cell", "h", "ids", "v"]]


def block_bounds(sizes: np.ndarray, most: int = BLOCK_ENTRIES) -> np.ndarray:
    """The first block of each cell, and one past the last cell's: small cells in a row share one, large ones have several."""
    first, block, held = np.zeros(len(sizes) + 1, np.int64), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            block, held = block + 1, 0
        first[cell] = block
        if n > most:
            block, held = block + -(-n // most), 0
        else:
            held += n
    first[-1] = block + 1
    return first


def _probe(sent, want: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query, the blocks of the cells that its walk reaches, each with those cells."""
    index, first = sent.value
    for part in batches:
        out = {"query_id": [], "q": [], "block": [], "cells": []}
        for own, v in zip(part["vec_id"], part["v"], strict=True):
            cells = np.sort(np.array(index.walk(np.asarray(v, np.float64), want), np.int64))
            size = index.sizes.ravel()[cells]
            several = np.maximum(1, -(-size // BLOCK_ENTRIES))
            block = np.repeat(first[cells], several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
            cell = np.repeat(cells, several)
            for at in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if len(at):
                    for c, x in zip(out, (own, v, int(block[at[0]]), cell[at]), strict=True):
                        out[c].append(x)
        yield pd.DataFrame(out)


def _rerank(k: int, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The k best of one block of entries for each query of one slice, among the cells that it probes.

    Ties at the k-th place go to smaller ids.
    """
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(entries):
        entries = entries.sort_values("cell", kind="stable")
        x, ids = np.stack(entries["v"].to_numpy()).astype(np.float64), entries["ids"].to_numpy()
        low = np.array([i[0] for i in ids])
        cells, first = np.unique(entries["cell"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(x))
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256]
            q = np.stack(part["q"].to_numpy()).astype(np.float64)
            bits = np.stack([np.isin(cells, c) for c in part["cells"]])
            scores = np.full((len(part), len(x)), -np.inf)
            for c, (a, b) in enumerate(zip(first, ends, strict=True)):
                probing = np.flatnonzero(bits[:, c])
                if len(probing):
                    scores[probing, a:b] = q[probing] @ x[a:b].T
            for own, s in zip(part["query_id"].tolist(), scores, strict=True):
                top = np.flatnonzero(s >= (np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf))
                top = top[np.isfinite(s[top])]
                best = top[np.lexsort((low[top], -s[top]))][: k + 1]  # one entry may be the query alone
                found = sorted((-float(s[e]), int(i)) for e in best for i in ids[e] if i != own)[:k]
                out["query_id"] += [own] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-v for v, _ in found]
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def reranker(k: int):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return _rerank(k, queries, entries)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int | None = None, recall: float = 0.95, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, by inner product; ties to the smaller vec_id.

    vectors and queries have vec_id and a vector column. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without vec_id, nor vectors of another length than most have (the longer, of
    lengths that as many have). A query isn't its own neighbour. Rows that repeat a vec_id and a vector count once. Fewer
    candidates than k give all of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(df["vec_id"].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    shape = "query_id long, rank int, vec_id long, score double"
    length = clean(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], shape)
    of_length = lambda df: clean(df).where(F.size("v") == length["n"]).distinct()
    place = Window.partitionBy("v").orderBy("vec_id")
    kept = of_length(vectors).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    entries = stage(kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")  # k + 1 ids at most
    index = fit(entries, k, centroids, recall)
    sent = spark.sparkContext.broadcast(index)
    filed = stage(entries.withColumn("h", F.xxhash64("v", F.lit(5))).mapInPandas(partial(_file, sent), "cell long, h long, ids array<long>, v array<double>"), "filed")
    index.sizes[:] = 0
    for r in filed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        index.sizes.flat[r["cell"]] = r["count"]
    total = int(index.sizes.sum())
    want = max(min(total, 4 * k), int(np.ceil(index.share * total)))
    first = block_bounds(index.sizes.ravel())
    sent = spark.sparkContext.broadcast((index, first))
    wanted = of_length(queries)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // 1000))
    asked = stage(wanted.repartition(tasks, "vec_id").mapInPandas(partial(_probe, sent, want), "query_id long, q array<double>, block long, cells array<long>"), "asked")
    routed = stage(asked.groupBy("block").agg(F.ceil(F.count("*") / SLICE_QUERIES).cast("int").alias("slices")), "routed")
    starts = spark.createDataFrame([(c, int(a), max(1, -(-int(n) // BLOCK_ENTRIES))) for c, (a, n) in enumerate(zip(first, index.sizes.ravel(), strict=False)) if n], "cell long, first long, several int")
    held = filed.join(F.broadcast(starts), "cell").withColumn("block", F.col("first") + F.pmod("h", "several")).drop("first", "several", "h")  # one row a cell
    held = held.join(broadcast_small(routed), "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    asked = asked.join(broadcast_small(routed), "block").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).drop("slices")
    found = asked.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInPandas(reranker(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
