"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the 2- to 4-byte pieces of its lower-cased UTF-8 letters; a piece may touch the space before or
behind a word but not lie across it. Each piece's hash names a row of an embedding table, a text is the mean of its
pieces' rows, and a linear softmax on that mean gives the languages. Table and softmax are trained together by
stochastic gradient descent in numpy on a bounded, documented sample (``per_language`` rows of each language). A fifth
of the sample is kept back: on it a temperature is fitted, so that score is a probability, and the score under which a
prediction is rejected is set (``rejected_share`` of known-good texts at most, and never a score over ``sure``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._split import append_columns, bounded_sample, remainder
from docloom.llm._text import begin, release

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BUCKET_BITS = 14
PIECE = 1 << 20
PREDICTED = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class LanguageModel:
    """Bucket rows of the folded table (embedding times softmax), one column a language; with more languages than the
    embedding has dimensions the two stay apart, so the table has 2**14 x 16 floats at most, for any number of languages."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    soft: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, means: np.ndarray) -> np.ndarray:
        """Of the means of the table's rows."""
        return (means if self.soft is None else means @ self.soft) + self.bias


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the piece that begins at each byte, or the one past the last where none does."""
    n = len(data) - order + 1
    code = np.zeros(n, np.uint32)
    inner = np.ones(n, bool)
    for j in range(order):
        part = data[j : j + n]
        code |= part.astype(np.uint32) << np.uint32(8 * j)
        if 0 < j < order - 1:
            inner &= part > 0
    if order == 2:
        inner = code > 0
    code = code * np.uint32(2654435761) + np.uint32(order * 40503)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    return np.where(inner, (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), 1 << BUCKET_BITS)


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as bytes, each other byte 0, and where each text begins; a 0 parts texts."""
    coded = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    data = np.frombuffer(b" " + b" ".join(coded) + b"    ", np.uint8)
    return np.where(_LETTER[data], data, 0).astype(np.uint8), starts


def _groups(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most and i > first:
            yield first, i
            first, size = i, len(t or "")
    yield first, len(texts)


def _sums(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the sum of its pieces' rows in table (whose last row is 0), and how many pieces it has."""
    data, starts = _bytes(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for at in range(0, int(starts[-1]), PIECE):  # a long text is taken piece by piece, all of it
        end = min(at + PIECE, int(starts[-1]))
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, end, "left"))
        cuts = np.maximum(starts[first:last], at) - at
        for order in ORDERS:
            b = _buckets(data[at : end + order - 1], order)
            total[first:last] += np.add.reduceat(table[b], cuts, axis=0)
            count[first:last] += np.add.reduceat((b < 1 << BUCKET_BITS).astype(np.int32), cuts)
    return total, count


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated score and whether it is rejected, of each whole text."""
    n = len(texts)
    langs, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if not model.languages:
        return langs, score, rejected
    for a, b in _groups(texts):
        part = texts[a:b]
        total, count = _sums(part, model.table)
        logits = model.logits(total / np.maximum(count, 1)[:, None]) / model.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, t in enumerate(part):
            if has_letter(t):
                langs[a + i], score[a + i] = model.languages[best[i]], p[i, best[i]]
                rejected[a + i] = p[i, best[i]] < model.least
    return langs, score, rejected


def features(texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Distinct buckets of a text (uint16) and their shares of its pieces (float32)."""
    for t in texts:
        data, _ = _bytes([t.as_py()])
        b = np.concatenate([_buckets(data, order) for order in ORDERS])
        count = np.bincount(b, minlength=(1 << BUCKET_BITS) + 1)[:-1]
        at = np.flatnonzero(count)
        yield at.astype(np.uint16).tobytes(), (count[at] / max(1, count.sum())).astype(np.float32).tobytes()


def packed(at: bytes, share: bytes) -> tuple[bytes, bytes]:
    """Buckets and shares of a text as they go to the driver: steps between buckets, and shares of which few differ, deflated."""
    return zlib.compress(np.diff(np.frombuffer(at, np.uint16), prepend=np.uint16(0)).tobytes(), 1), zlib.compress(share, 1)


def unpacked(at: bytes, share: bytes) -> tuple[bytes, bytes]:
    return np.cumsum(np.frombuffer(zlib.decompress(at), np.uint16), dtype=np.uint16).tobytes(), zlib.decompress(share)


def fit(rows: list[tuple[str, bytes, bytes]], dims: int = 16, epochs: int = 6, rate: float = 0.6, sure: float = 0.5, rejected_share: float = 0.001) -> LanguageModel:
    """Train on (language, buckets, shares), all but each fifth, and calibrate on those. No rows give no languages."""
    rows = [(y, np.frombuffer(i, np.uint16), np.frombuffer(v, np.float32)) for y, i, v in sorted(set(rows))]
    rows = [r for r in rows if len(r[1])]
    model = LanguageModel(sorted({r[0] for r in rows}))
    n = len(model.languages)
    if not n:
        return model
    number, rng = {y: k for k, y in enumerate(model.languages)}, np.random.default_rng(11)
    order = rng.permutation(len(rows))
    test = [rows[i] for i in order[::5]] if len(rows) >= 50 else rows
    train = [rows[i] for k, i in enumerate(order) if k % 5] if len(rows) >= 50 else rows
    seen = np.bincount([number[r[0]] for r in train], minlength=n)
    weight = np.minimum(10, len(train) / (n * np.maximum(seen, 1)))
    embedding = rng.normal(0, 0.5, (1 << BUCKET_BITS, dims))
    soft, bias = np.zeros((dims, n)), np.zeros(n)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            y, at, share = train[k]
            h = share @ embedding[at]
            z = h @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[y]] -= 1
            p *= step * weight[number[y]]
            embedding[at] -= 20 * share[:, None] * (soft @ p)[None, :]
            soft -= np.outer(h, p)
            bias -= 0.1 * p
    if n > dims:
        model.soft = soft.astype(np.float32)
    else:
        embedding = embedding @ soft
    model.table = np.vstack([embedding, np.zeros((1, embedding.shape[1]))]).astype(np.float32)
    model.bias = bias
    z = model.logits(np.array([share @ model.table[at] for _, at, share in test]))
    y = np.array([number[r[0]] for r in test])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y]).mean())

    model.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
    s = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
    right = (s.max(axis=1) / s.sum(axis=1))[s.argmax(axis=1) == y]
    model.least = float(min(sure, np.quantile(right, rejected_share, method="lower") * 0.9)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, folds: int = 5, per_language: int = 1500, most: int = 24_000, text: str = "text") -> LanguageModel:
    """Fit on texts with a language whose crc32 of doc_id mod folds isn't 0: per_language distinct ones of each language.

    With over most / per_language languages, each gets its part of ``most`` texts (one at least), so what comes to the
    driver has a bound: the buckets of about ``most`` texts, deflated to some 2 bytes for each that a text has. Texts are
    chosen by their hash; repeated rows count once, whatever their doc_id.
    """
    rows = docs.select(docs["doc_id"].alias("d_id"), docs[text].alias("d_text"), docs["lang"].alias("d_lang"))
    rows = rows.where(F.col("d_lang").isNotNull() & F.col("d_text").isNotNull() & (remainder(F.col("d_id"), folds) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of the sample only
        for batch in batches:
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = []
            for i, name in enumerate(names):
                if name not in seen:
                    seen.add(name)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            at, share = zip(*(packed(*x) for x in features(batch.column(0))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["lang", "at", "share"])

    languages = rows.select("d_lang").distinct().count()
    chosen = bounded_sample(rows, "d_lang", max(1, min(per_language, most // max(1, languages))), ["d_text"]).select("d_text", "d_lang", F.xxhash64("d_text").alias("h"))
    got = chosen.mapInArrow(run, "lang string, at binary, share binary").dropDuplicates().collect()
    model = fit([(r.lang, *unpacked(bytes(r["at"]), bytes(r.share))) for r in got])
    del got
    release()  # of the driver's memory
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected for every row; whole texts are read.

    A null text, and one with no letter, has lang_pred "und", score 0 and is rejected; so has every text if no language
    was learned. Repeated rows get equal results. Other columns pass through; columns of the added names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(sent, column: pa.Array) -> dict:
        begin("language")
        langs, score, rejected = [], [], []
        for at in range(0, len(column), 500):
            a, b, c = predict(column.slice(at, 500).to_pylist(), sent.value)
            langs += a
            score.append(b)
            rejected.append(c)
        return {"lang_pred": langs, "score": np.concatenate(score) if score else [], "rejected": np.concatenate(rejected) if rejected else []}

    return append_columns(docs, text, partial(compute, sent), PREDICTED)
