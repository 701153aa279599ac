"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, extended to runs.

A run is a stretch of consecutive words with smallest period q, of at least max(6, 4 q) words, that no neighbour extends.
Every run holds Lyndon roots, words of length q that are smaller than their rotations, and for one of the two orders of the
alphabet the longest Lyndon word that begins at such a root is the root itself. So the lengths of the longest Lyndon words at
all places, under both orders, are all the candidates (place, period); each is extended to both sides as far as words q apart
agree.

``lyndon`` gets these lengths as Baier's suffix sorter does in its first phase, which groups suffixes by their longest Lyndon
prefix: groups are taken from the largest down; a group's suffixes leave, and what stands before each of them, the nearest
suffix that has not left, gets the group's prefix appended, which moves it to a new group right above its old one. No suffix
array is made. A place costs a few steps in Python, so texts are first looked through, in numpy, for stretches that could hold
a run: where words 1 to 7 apart agree, or each 8 words come again later in the text, for as long as a run of such a period
must. The bound is proved at ``regions``; it leaves out no run, and prose without repetition costs no Lyndon array.

Defined results. Null, empty and blank texts have no words and no run. A text of one word repeated is one run of period 1.
Texts of any length are read whole. Repeated rows and null ids have rows of their own. Columns of other names do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm._text import SPACED, chunks, mix, words
from docloom.llm._text import runs as bounds

LEAST, TIMES = 6, 4
GRAM = 8
Run = tuple[int, int, int]
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def least_length(period: int) -> int:
    return max(LEAST, TIMES * period)


def lyndon(word: list[int], kinds: int) -> list[int]:
    """At each place the length of the longest Lyndon word that begins there; word holds ranks from 0 to kinds - 1."""
    n = len(word)
    left, right = [n, *range(n)], [*range(1, n + 1), 0]  # of the suffixes that haven't left; n is the end on either side
    size, group = [1] * (n + 1), list(word)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, w in enumerate(word):
        members[w].append(i)
    below, above = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    g = kinds - 1
    while g >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        last, times = n, 0
        for s in members[g]:  # in text order, also in new groups
            if group[s] != g:
                continue
            p, r = left[s], right[s]
            right[p], left[r] = r, p
            if p != last:
                if times:
                    moved.setdefault((group[last], times), []).append(last)
                last, times = p, 0
            if p != n:
                size[p] += size[s]
                times += 1
        if times:
            moved.setdefault((group[last], times), []).append(last)
        members[g] = []
        at = old = -1
        for key in sorted(moved) if len(moved) > 1 else moved:
            if key[0] != old:
                at = old = key[0]
            new = len(members)
            members.append(moved[key])
            below.append(at)
            above.append(above[at])
            below[above[at]] = new
            above[at] = new
            for p in moved[key]:
                group[p] = new
            at = new
        g = below[g]
    return size[:n]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values of a and b agree; looks at pieces of growing length."""
    n, at, step = min(len(a), len(b)), 0, 16
    a, b = a[:n], b[:n]
    while at < n:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 2
    return n


def find_runs(word: np.ndarray, kinds: int) -> list[Run]:
    """(start, length, period) of all runs of a sequence of numbers from 0 to kinds - 1, by start, then period."""
    n, found = len(word), set()
    for ranks in (word, kinds - 1 - word):
        size = np.array(lyndon(ranks.tolist(), kinds), np.int64)
        # a run of four periods has three whole roots side by side
        i = np.flatnonzero(np.arange(n) + 3 * size <= n)
        q = size[i]
        ok = (size[i + q] == q) & (size[i + 2 * q] == q) & (word[i] == word[i + q])
        reached: dict[int, int] = {}
        for a, p in zip(i[ok].tolist(), q[ok].tolist(), strict=True):
            if reached.get(p, 0) >= a + 2 * p:
                continue
            end = a + p + _agree(word[a:], word[a + p :])
            start = a - _agree(word[:a][::-1], word[p : a + p][::-1])
            reached[p] = end
            if end - start >= least_length(p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each stretch of at least ``least`` true values."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= least
    return first[long], end[long]


def regions(row: np.ndarray, value: np.ndarray) -> list[tuple[int, int]]:
    """Places [first, end) of the words (row, value), each within a row, such that each run of a row is inside of one with a
    word to spare on both sides, or with the row's edge.

    A run of period q from s to e has value[i] = value[i + q] for e - s - q >= max(6, 4 q) - q places from s on. For q < 8 that
    is looked for as it is. For q >= 8 the 8 words from i on come again at i + q, for i from s to e - q - 8: at least
    3 q - 7 >= 17 places side by side, from each of which the next like place is at most q away. A stretch of n such places
    with a least distance d has d <= q and q <= (n + 7) / 3, so 3 d - 7 <= n; and the run ends at most q + 8 after it.
    """
    n, found = len(row), []
    ends = np.searchsorted(row, row, "right") if n else row
    for q in range(1, GRAM):
        if n > q:
            a, b = _stretches((value[:-q] == value[q:]) & (row[:-q] == row[q:]), least_length(q) - q)
            found += [(x - 1, y + q + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    if n >= GRAM:
        h = value
        for k, step in enumerate((1, 2, 4)):
            h = mix(h[: len(h) - step] * np.uint64(2 * k + 3) + h[step:] * np.uint64(0x9E3779B97F4A7C15))
        whole = row[: len(h)] == row[GRAM - 1 :]
        at = np.flatnonzero(whole)
        h = h[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        away = np.zeros(len(whole), np.int64)
        away[at[order[:-1][same]]] = (at[order[1:]] - at[order[:-1]])[same]
        a, b = _stretches(away > 0, 3 * GRAM - 7)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if 3 * int(away[x:y].min()) - 7 <= y - x:
                found.append((x - 1, y + (y - x + 7) // 3 + GRAM + 1))
    out: list[tuple[int, int]] = []
    clipped = []
    for x, y in found:
        inside = x + 1  # a place that is in the region's row
        first = int(np.searchsorted(row, row[inside]))
        clipped.append((max(x, first), min(y, int(ends[inside]))))
    for x, y in sorted(clipped):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def collapsed(said: list[bytes], found: list[Run]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if found:
        kept = np.ones(len(said), bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        said = [said[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(said)


def repeat_rule(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for documents whose words from a on are made to repeat the p words from there; None for others.

    Of h = crc32 of the decimal doc_id, those with h % 10 = 0 and any words.
    """
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def texts_runs(ids: list[int | None], texts: pa.Array, rewrite: Rewrite | None = None) -> Iterator[tuple[list[Run], list[bytes]]]:
    """(runs, words) of each text; rewrite(id, number of words) gives (a, p) where words are first made periodic."""
    for top, end, data, offsets in chunks(texts):
        row, value, _ = words(data, offsets, SPACED, fold=False)
        first = bounds(row, end - top)
        place = np.arange(len(row))
        changed: dict[int, np.ndarray] = {}
        for r in range(end - top):
            n = int(first[r + 1] - first[r])
            if rewrite and (rule := rewrite(ids[top + r], n)):
                a, p = rule
                changed[r] = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
                place[first[r] : first[r + 1]] = first[r] + changed[r]
        at: dict[int, list[tuple[int, int]]] = {}
        for x, y in regions(row, value[place]):
            at.setdefault(int(row[x]), []).append((x - int(first[row[x]]), y - int(first[row[x]])))
        for r in range(end - top):
            said = data[offsets[r] : offsets[r + 1]].tobytes().split()
            if r in changed:
                said = [said[i] for i in changed[r].tolist()]
            found: list[Run] = []
            for x, y in at.get(r, []):
                number: dict[bytes, int] = {}
                seen = np.array([number.setdefault(w, len(number)) for w in said[x:y]], np.int64)
                found += [(x + s, length, q) for s, length, q in find_runs(seen, len(number))]
            yield found, said


def _row(found: list[Run], said: list[bytes]) -> tuple:
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *numbers, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(said, found)).hexdigest()


_ADDED = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, text: str = "text", id: str = "doc_id", rewrite: Rewrite | None = repeat_rule) -> DataFrame:
    """One row a document: its number of runs, the run of the largest exponent, digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(*x) for x in texts_runs(b[0].to_pylist(), b[1], rewrite)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ADDED)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *_ADDED])

    return docs.select(docs[id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def spans(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, period): every run of the texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b[0].to_pylist()
            rows = [(i, *r) for i, (found, _) in zip(ids, texts_runs(ids, b[1]), strict=True) for r in found]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "period"])

    return docs.select(docs[id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the texts that hold runs replaced by their collapsed form; other texts, nulls and columns stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [collapsed(said, found).decode() if found else None for found, said in texts_runs([None] * b.num_rows, b[at])]
            held = pa.array([o if n is None else n for o, n in zip(b[at].to_pylist(), new, strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], held, *b.columns[at + 1 :]], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
