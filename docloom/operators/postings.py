"""Posting lists: an inverted index as a staged table, and the best documents of many questions by its bounds.

The texts are read and tokenised once. Each task inverts its own documents in segments of some four million words, so building
the index shuffles nothing, and a word that every document holds is one posting list a segment. A list carries its largest
term frequency and its shortest document, which bound what the word can add to any document of the segment.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.latest import look_up
from docloom.storage import spread, stage

SEGMENT_WORDS = 1 << 22
#: Questions that are scored together in one task.
QUERY_BLOCK = 500
#: Scores are rounded to six decimals, so a bound must be lower by more than that to rule a document out.
SLACK = 2e-6
_WORD = re.compile(r"[^ \t\n\r\f]+")
_LISTS = "word string, segment long, n int, max_tf int, min_dl int, ids binary, tfs binary, dls binary, docs long, texts long, words long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in _LISTS.split(", "))])
#: Rows of a batch that a task gives back.
_ROWS = 20_000
_BEST = "query_id long, doc_id long, score double"


class _Segment:
    """The documents of a segment while they are read: each word as its number in order of first sight."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int] = []
        self.said: list[np.ndarray] = []
        self.docs = self.words = 0

    def add(self, doc_id: int, text: str | None) -> None:
        self.docs += 1
        if text is None:
            return
        said = _WORD.findall(text)
        self.ids.append(doc_id)
        self.said.append(np.fromiter(map(self.number.__getitem__, said), np.int32, len(said)))
        self.words += len(said)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The row that counts the segment, then the posting lists by word; within a list by document."""
        yield pa.RecordBatch.from_pylist([{"segment": segment, "docs": self.docs, "texts": len(self.ids), "words": self.words}], _ARROW)
        if not self.words:
            return
        by_id = np.argsort(np.array(self.ids, np.int64), kind="stable")
        ids, sizes = np.array(self.ids, np.int64)[by_id], np.array([len(self.said[i]) for i in by_id], np.int32)
        names = sorted(self.number)
        place = np.empty(len(names), np.int64)
        place[np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        # one array of a number for each word said, worked on in place: its word by name, then its document
        pairs = place.take(np.concatenate([self.said[i] for i in by_id]))
        self.said, self.number = [], defaultdict()
        pairs *= len(ids)
        pairs += np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pairs.sort()
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        tfs = np.diff(first, append=len(pairs)).astype(np.int32)
        pairs = pairs[first]
        del first, place
        starts = np.searchsorted(pairs, np.arange(len(names) + 1) * len(ids))
        most = np.maximum.reduceat(tfs, starts[:-1])
        for a in range(0, len(names), _ROWS):
            cut = starts[a : a + _ROWS + 1]
            n = len(cut) - 1
            doc = pairs[cut[0] : cut[-1]] % len(ids)
            dls = sizes[doc]
            least = np.minimum.reduceat(dls, cut[:-1] - cut[0])
            packed = [_packed(v, cut - cut[0]) for v in (ids[doc], tfs[cut[0] : cut[-1]], dls)]
            none = [pa.nulls(n, pa.int64())] * 3
            columns = [pa.array(names[a : a + n]), pa.array(np.full(n, segment)), pa.array(np.diff(cut).astype(np.int32)), pa.array(most[a : a + n]), pa.array(least)]
            yield pa.RecordBatch.from_arrays([*columns, *packed, *none], schema=_ARROW)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each slice of values, between starts, as bytes."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    segment = _Segment()
    for b in batches:
        for doc_id, text in zip(b[0].to_pylist(), b[1], strict=True):
            segment.add(doc_id, text.as_py())
            if segment.words >= SEGMENT_WORDS:
                yield from segment.rows(number)
                number, segment = number + 1, _Segment()
    if segment.docs:
        yield from segment.rows(number)


def _gain(tf: np.ndarray, dl: np.ndarray, k1: float, b: float, mean: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


class _Lists:
    """The posting lists that a block of questions needs of one segment."""

    def __init__(self, table: pa.Table, k1: float, b: float, mean: float) -> None:
        self.shape = k1, b, mean
        self.ids = [np.frombuffer(x.as_py(), np.int64) for x in table["ids"]]
        self.tfs = [np.frombuffer(x.as_py(), np.int32) for x in table["tfs"]]
        self.dls = [np.frombuffer(x.as_py(), np.int32) for x in table["dls"]]
        self.docs = np.unique(np.concatenate(self.ids))
        self.places = [np.searchsorted(self.docs, x) for x in self.ids]
        self.most = _gain(table["max_tf"].to_numpy().astype(float), table["min_dl"].to_numpy(), *self.shape)
        self.whole: dict[int, np.ndarray] = {}

    def gains(self, i: int) -> np.ndarray:
        if i not in self.whole:
            self.whole[i] = _gain(self.tfs[i], self.dls[i], *self.shape)
        return self.whole[i]

    def best(self, asked: list[tuple[int, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents for a question's (list, weight).

        Lists come by the most that they can add; negative weights come first. Once k documents surely score more than all
        lists to come can add, no other document is looked at, and those left are looked up in the long lists.
        """
        bound = lambda t: max(0.0, t[1] * self.most[t[0]])
        terms = sorted(asked, key=lambda t: (t[1] >= 0, -bound(t)))
        rest = np.append(np.cumsum([bound(t) for t in reversed(terms)])[::-1], 0.0)
        least_negative = next((i for i, t in enumerate(terms) if t[1] >= 0), len(terms))
        score, met, left = np.zeros(len(self.docs)), np.zeros(len(self.docs), bool), None
        for i, (number, weight) in enumerate(terms):
            place = self.places[number]
            if left is None:
                score[place] += weight * self.gains(number)
                met[place] = True
            else:
                at = np.minimum(np.searchsorted(place, left), len(place) - 1)
                there = place[at] == left
                at = at[there]
                score[left[there]] += weight * _gain(self.tfs[number][at], self.dls[number][at], *self.shape)
            if i + 1 < least_negative or i + 1 == len(terms):
                continue
            pool = np.flatnonzero(met) if left is None else left
            if len(pool) > k:
                held = score[pool]
                sure = np.partition(held, -k)[-k] - SLACK
                if left is not None or rest[i + 1] < sure:
                    left = pool[held + rest[i + 1] >= sure]
        left = np.flatnonzero(met) if left is None else left
        held = np.round(score[left], 6)
        if len(left) > k:
            near = held >= np.partition(held, -k)[-k]
            left, held = left[near], held[near]
        order = np.lexsort((left, -held))[:k]  # places ascend by id
        return self.docs[left[order]], held[order]


def _best_of_segment(k: int, k1: float, b: float, mean: float, table: pa.Table) -> pa.Table:
    lists, asked = _Lists(table, k1, b, mean), {}
    for i, said in enumerate(table["asked"].to_pylist()):
        for q in said:
            asked.setdefault(q["query_id"], []).append((i, q["weight"]))
    out = [(q, *lists.best(terms, k)) for q, terms in asked.items()]
    return pa.table({
        "query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), [len(i) for _, i, _ in out]),
        "doc_id": np.concatenate([i for _, i, _ in out]),
        "score": np.concatenate([s for _, _, s in out]),
    })


@dataclass
class PostingIndex:
    """lists: a row for each word of a segment, and one without a word that counts the segment; n: documents; mean: words
    of a document that has a text."""

    lists: DataFrame
    n: int
    mean: float

    @classmethod
    def build(cls, docs: DataFrame) -> PostingIndex:
        """The index of docs (doc_id, text), staged. Documents without an id are left out; one without a text counts."""
        rows = spread(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
        lists = stage(rows.mapInArrow(_invert, _LISTS), "postings")
        n, texts, words = lists.where("word IS NULL").agg(F.sum("docs"), F.sum("texts"), F.sum("words")).first()
        return cls(lists, n or 0, words / texts if texts else 0.0)

    def frequencies(self) -> DataFrame:
        """(word, df) of all words."""
        return self.lists.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("df"))

    def weights(self, queries: DataFrame, epsilon: float = 0.25) -> DataFrame:
        """(query_id, word, weight) of queries (query_id, text): the word's inverse document frequency by its times in the
        query. Negative ones become epsilon times the mean of all words'."""
        idf = self.frequencies().select("word", (F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean = idf.agg((F.avg("idf") * epsilon).alias("floor"))  # one row; Spark counts the words once for both
        words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
        asked = queries.select("query_id", F.explode(words).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
        met = asked.join(idf, "word").join(F.broadcast(mean))
        return met.select("query_id", "word", (F.col("times") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"))

    def topk(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """(query_id, doc_id, rank, score): each query's k best documents of those that share a word with it.

        Only lists of asked words are read; those of one segment meet the questions of one block in a task, and what leaves
        it are k documents a question. Any number of questions is one job.
        """
        if not self.n:
            return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, rank long, score double")
        weights = stage(self.weights(queries, epsilon), "weights")
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        weights = weights.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        asked = weights.groupBy("word", "block").agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("query_id"), "weight")).alias("asked"))
        lists = self.lists.where("word IS NOT NULL").select("word", "segment", "max_tf", "min_dl", "ids", "tfs", "dls")
        met = look_up(lists, asked, ["word"], "segment", most=10_000)
        mean = self.mean

        def best(table: pa.Table) -> pa.Table:
            return _best_of_segment(k, k1, b, mean, table)

        found = met.groupBy("segment", "block").applyInArrow(best, _BEST)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")
