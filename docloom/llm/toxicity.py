"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks.

A text's units are its lower-cased words, letters only, and runs of single letters joined ("i d i o t"). The kernel
K(u, l) sums decay ** (span in u + span in l) over common subsequences of ``order`` letters, gaps allowed, divided by
sqrt(K(u, u) K(l, l)). So an insult with letters inserted or left out stays near its landmark. Landmarks are units of
labelled texts. Kernel values count from a floor
up to full likeness. A text's features are, for each landmark, the largest value over its units, the sum of the values
in proportion to the units, and the logarithm of that sum; Nyström's K(L, L) ** -1/2 whitens each of the three. A linear
support vector machine trained by dual coordinate descent separates them, and Platt's sigmoid turns margins to scores.

Learning takes a bounded sample of labelled rows (``per_label`` of each label); scoring reads every whole text.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._split import append_columns, bounded_sample, remainder
from docloom.llm._text import KEPT, begin, release

WIDTH = 24
COST = 0.1
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
_OTHER = re.compile(r"[\W\d_]+")
_UNITS_KEPT = 1 << 19


@dataclass
class ToxicityModel:
    """What scoring needs: some hundred numbers for each of at most ``landmarks`` short strings."""

    order: int = 3
    decay: float = 0.75
    floor: float = 0.35
    full: float = 0.65
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # 3 for each landmark, Nyström's matrix folded in
    bias: float = -3.0
    slope: float = 1.0


def letters(word: str) -> str:
    return word if word.isalpha() else _OTHER.sub("", word)


def units(text: str | None) -> Counter:
    """How often a whole lower-cased text has each word, and each run of three or more single letters, joined."""
    words = text.lower().split() if text else []
    counted = Counter(words)
    short = [i for i, w in enumerate(words) if len(w) < 4 and len(letters(w)) == 1]
    at = 0
    while at < len(short):
        end = at + 1
        while end < len(short) and short[end] == short[end - 1] + 1:
            end += 1
        if end - at > 2:
            counted["".join(letters(words[i]) for i in short[at:end])] += 1
        at = end
    return counted


def _coded(strings: list[str], width: int) -> np.ndarray:
    """Code points, 0 behind the end."""
    joined = np.frombuffer("".join(s[:width].ljust(width, "\0") for s in strings).encode("utf-32-le"), np.uint32)
    return joined.reshape(len(strings), width)


def _bits(coded: np.ndarray) -> np.ndarray:
    """A set of letters as 64 bits."""
    bit = np.where(coded > 0, np.uint64(1) << (coded.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    return np.bitwise_or.reduce(bit, axis=1)


def kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Unnormalised subsequence kernel of rows a[i] and b[i], code points padded with 0."""
    n, la = a.shape
    lb = b.shape[1]
    d, d2 = np.float32(decay), np.float32(decay * decay)
    total = np.zeros(n, np.float32)
    prime = np.zeros((order, lb + 1, n), np.float32)
    prime[0] = 1
    bt = np.ascontiguousarray(b.T)
    for i in range(la):
        x = a[:, i]
        same = (bt == x) & (x > 0)
        if not same.any():
            for k in range(1, order):
                prime[k] *= d
            continue
        same = same.astype(np.float32) * d2
        total += (same * prime[order - 1, :lb]).sum(axis=0)
        for k in range(order - 1, 0, -1):
            gained = same * prime[k - 1, :lb]
            prime[k] *= d
            running = np.zeros(n, np.float32)
            for j in range(lb):
                running = running * d + gained[j]
                prime[k, j + 1] += running
    return total


def _most(shared: np.ndarray, b: np.ndarray, own: np.ndarray, order: int, decay: float) -> np.ndarray:
    """For each piece and landmark, what their normalised kernel can't exceed, from the letters (as bits) that both have.

    Only subsequences of shared letters are common. So, by Cauchy and Schwarz, the kernel is at most the norm of the piece
    times the norm of the landmark over such subsequences, which is the landmark's own kernel with other letters blank.
    """
    bit = np.where(b > 0, np.uint64(1) << (b.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    masks, backs = zip(*(np.unique(column, return_inverse=True) for column in shared.T), strict=True)
    cuts = np.cumsum([0, *map(len, masks)])
    mask, which = np.concatenate(masks), np.repeat(np.arange(len(b)), np.diff(cuts))
    most = np.zeros(len(mask))
    for at in range(0, len(mask), 8192):
        j = which[at : at + 8192]
        part = np.where(mask[at : at + 8192, None] & bit[j], b[j], np.uint32(0))
        most[at : at + 8192] = np.sqrt(kernel(part, part, order, decay) / np.maximum(own[j], 1e-12))
    return np.stack([most[a + back] for a, back in zip(cuts[:-1], backs, strict=True)], axis=1)


def pieces_of(string: str) -> list[str]:
    """The string, or, over WIDTH letters, overlapping pieces of it, so that no part goes unseen."""
    return [string[at : at + WIDTH] for at in range(0, max(1, len(string) - WIDTH // 2), WIDTH // 2)]


def similarities(strings: list[str], model: ToxicityModel, gate: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, landmark, normalised kernel) where the kernel is at least model.floor.

    With ``gate``, a pair is computed only if the letters that it shares allow the floor, which changes no result. Strings
    over WIDTH letters are taken in their pieces.
    """
    pieces, owner = [], []
    for i, s in enumerate(strings):
        mine = pieces_of(s)
        pieces += mine
        owner += [i] * len(mine)
    if not pieces or not model.landmarks:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    a, b = _coded(pieces, WIDTH), _coded(model.landmarks, WIDTH)
    ab, bb = _bits(a), _bits(b)
    own = kernel(b, b, model.order, model.decay)
    lengths = (b > 0).sum(axis=1).max()
    if gate:
        u, m = np.nonzero(_most(ab[:, None] & bb[None, :], b[:, :lengths], own, model.order, model.decay) >= model.floor - 1e-3)
    else:
        u, m = (x.ravel() for x in np.indices((len(a), len(b))))
    values = np.zeros(len(u))
    for at in range(0, len(u), 8192):
        i, j = u[at : at + 8192], m[at : at + 8192]
        seen, back = np.unique(i, return_inverse=True)
        cut = int((a[seen] > 0).sum(axis=1).max(initial=1))
        self_u = kernel(a[seen, :cut], a[seen, :cut], model.order, model.decay)[back]
        k = kernel(a[i, :cut], b[j, :lengths], model.order, model.decay)
        values[at : at + 8192] = k / np.sqrt(np.maximum(self_u * own[j], 1e-12))
    keep = values >= model.floor
    return np.asarray(owner, np.int64)[u[keep]], m[keep], values[keep]


class _Pooling:
    """Pooled kernel values of whole texts. Distinct units are computed once and kept, up to _UNITS_KEPT of them."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        m = len(self.model.landmarks)
        out = np.zeros((len(texts), 3 * m), np.float32)
        counted = [units(t) for t in texts]
        if len(self.known) > _UNITS_KEPT:
            self.known.clear()
        known = self.known
        new = list({u for c in counted for u in c if u not in known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(dict.fromkeys(part))
            for i, j, v in zip(*(x.tolist() for x in similarities([letters(u) for u in part], self.model)), strict=True):
                if (found := known[part[i]]) is None:
                    found = known[part[i]] = {}
                found[j] = max(found.get(j, 0.0), min(1.0, (v - self.model.floor) / (self.model.full - self.model.floor)))
        for row, count in zip(out, counted, strict=True):
            top, total = row[:m], row[m : 2 * m]
            for u, k in count.items():
                if (found := known[u]) is not None:
                    for j, v in found.items():
                        top[j] = max(top[j], v)
                        total[j] += k * v
            row[2 * m :] = np.log1p(total)
            total *= 100 / (count.total() + 60)
        return out


def choose_landmarks(said: list[str | None], toxic: np.ndarray, model: ToxicityModel, most: int) -> list[str]:
    """Units that mark toxic texts, best first: each by its log odds and the toxic texts that earlier ones reach least.

    A unit over WIDTH letters stands as its pieces. A unit is a candidate if toxic texts hold it over four times as often as
    others, and two of them do (one, where there are under eight); all candidates take part.
    """
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    texts, rows = [], [Counter(), Counter()]
    for t, y in zip(said, toxic, strict=True):
        mine = {v for u in units(t) for v in pieces_of(letters(u)) if len(v) > 2}
        rows[int(y)].update(mine)
        texts.append(tuple(map(sys.intern, mine)) if y else ())  # of texts, only the toxic ones' units are kept
    gain = {}
    for u, p in rows[1].items():
        odds = ((p + 0.5) / (n1 + 1)) / ((rows[0][u] + 0.5) / (n0 + 1))
        if odds > 4 and (p >= 2 or n1 < 8):
            gain[u] = np.log(odds)
    first = sorted(gain)
    holds = {u: [] for u in first}
    for i, t in enumerate(texts):
        if toxic[i]:
            for u in holds.keys() & t:
                holds[u].append(i)
    open_, chosen = np.ones(len(texts)), []
    while first and len(chosen) < most:
        best = max(first, key=lambda u: (gain[u] * open_[holds[u]].sum(), u))
        if gain[best] * open_[holds[best]].sum() < 0.5:
            break
        near = ToxicityModel(model.order, model.decay, model.floor, landmarks=[best])
        like = np.unique(similarities(first, near)[0])
        reached = {i for k in like for i in holds[first[k]]}
        first.remove(best)
        chosen.append(best)
        open_[list(reached)] *= 0.6
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, cost: float, epochs: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge machine, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    c = cost * np.where(y > 0, max(1.0, (len(y) - y.sum()) / y.sum()) ** 0.5, 1.0)  # the rarer toxic texts weigh more
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 1 / (2 * c)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = sign[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c[i])
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return w


def fit(texts: list[str | None], toxic: list[int], landmarks: int = 40, cost: float = COST) -> ToxicityModel:
    """Learn from labelled texts. With one label only, every score is that label's share, smoothed."""
    model, y = ToxicityModel(), np.asarray(toxic, int)
    if not len(y) or y.min() == y.max():
        model.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0
        model.weights = np.zeros(0)
        return model
    model.landmarks = choose_landmarks(texts, y, model, landmarks)
    m = len(model.landmarks)
    if not m:
        model.bias, model.weights = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(0)
        return model
    pool = _Pooling(model)
    x = np.vstack([pool.features(texts[at : at + 250]) for at in range(0, len(texts), 250)]).astype(float)
    pool.known.clear()
    full = ToxicityModel(model.order, model.decay, -1.0, landmarks=model.landmarks)
    gram = np.zeros((m, m))
    i, j, v = similarities(model.landmarks, full, gate=False)
    gram[i, j] = v
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(m))
    root = vector @ np.diag(np.maximum(value, 0.05) ** -0.5) @ vector.T
    whiten = np.zeros((3 * m, 3 * m))
    for k in range(3):
        whiten[k * m : (k + 1) * m, k * m : (k + 1) * m] = root
    w = _svm(x @ whiten, y, cost)
    model.weights, model.bias = whiten @ w[:-1], float(w[-1])
    margin = x @ model.weights + model.bias
    slopes = np.linspace(0.5, 8, 31)
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * s * margin).mean() for s in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    return model


_POOLS: dict[int, _Pooling] = {}
KEPT.append(_POOLS)


def scores(texts: list[str | None], model: ToxicityModel, key: int = 0) -> np.ndarray:
    if not model.landmarks:
        return np.full(len(texts), 1 / (1 + np.exp(-model.bias)))
    pool = _POOLS.get(key)
    if pool is None or pool.model.landmarks != model.landmarks:
        _POOLS.clear()
        pool = _POOLS[key] = _Pooling(model)
    margin = pool.features(texts) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, per_label: int = 2500, text: str = "text") -> ToxicityModel:
    """Fit on labelled rows whose crc32 of doc_id mod folds isn't 0: per_label distinct texts of each label, by hash.

    Labels that are null or neither 0 nor 1 teach nothing; of repeated labels of one document, the largest counts. Rows
    that repeat an id and a text count once; an id's other texts each count.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    rows = docs.select(docs["doc_id"].alias("d_id"), docs[text].alias("d_text")).where(remainder(F.col("d_id"), folds) != 0)
    known = marks.join(rows.select("d_id").distinct(), F.col("l_id") == F.col("d_id"), "left_semi")
    chosen = bounded_sample(known, "l_toxic", 2 * per_label, ["l_id"])  # about 4 * per_label ids at most
    labelled = rows.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("d_text", "l_toxic")
    got = bounded_sample(labelled, "l_toxic", per_label, ["d_text"]).dropDuplicates().collect()
    got.sort(key=lambda r: (r.d_text or "", r.l_toxic))
    model = fit([r.d_text for r in got], [r.l_toxic for r in got])
    del got
    release()  # of the driver's memory
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5) for every row.

    Null and empty texts have no units and get the score of no evidence. Texts are read whole, however long. Repeated
    rows get equal scores. Other columns pass through; columns named score or predicted are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(sent, column: pa.Array) -> dict:
        begin("toxicity")
        found = np.zeros(len(column))
        for at in range(0, len(column), 500):
            found[at : at + 500] = scores(column.slice(at, 500).to_pylist(), sent.value)
        return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

    return append_columns(docs, text, partial(compute, sent), SCORED)
