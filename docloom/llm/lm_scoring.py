"""Language-model scores by logistic context mixing, and a unigram base to hold them against.

A text is its UTF-8 bytes, A-Z as a-z, and one end symbol; each symbol is some binary decisions, down a prefix code in
which frequent bytes are short. For each decision, a predictor of each order (2 and 4 bytes before) and one whose context
is the word so far look up, in hashed tables, how often the bit was set in their context: a state of counts, which an
adaptive table turns to a prediction. The predictions are mixed in the logistic domain by weights that a gate selects: the
longest context that was seen, how often, and which of the decisions it is. The mixed prediction is refined by an adaptive
table (decisions so far in this byte by buckets of the prediction) and averaged with it. A word with the cut behind it is
refined once more, by its exact count among training words and by how often it followed the word before it: the three are
averaged by weights that a gate (how often the word before was seen) selects, so that they stay a probability.

All training texts teach all of it. The code comes from all their bytes. Then each task goes through its texts online, in
chunks: all of a chunk is predicted from what the chunks before it counted, which moves the mixing
weights and adds to the adaptive tables; then it is counted. Counts and tables are summed over the tasks, weights averaged by how much each task
saw of their gate. After that all is fixed, so a text's score doesn't depend on the other texts to score. The score is the
log10 of the probability of all of the text; bits_per_byte is the same, by its bytes and end.

What is learned by context has tables of fixed size (``SLOT_BITS`` of each predictor, ``PAIR_BITS`` of word pairs, of which
each slot keeps the most frequent, told from others by 62 bits), which bounds what is broadcast however large the corpus is. The exact counts of words
grow with the corpus; they stay in shards, and texts ask for them there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._split import remainder
from docloom.llm._text import LOWER, SPACED, _powers, chunks, mix, words
from docloom.storage import stage, unstage

#: Predictors: contexts of so many bytes, and the last one's the word up to here.
BYTES = (2, 4)
ORDERS = len(BYTES) + 1
SLOT_BITS, BLOCK_BITS, PAIR_BITS = (20, 21, 21), 16, 22
_FROM = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
SLOTS = int(_FROM[-1])
TABLE_BLOCKS, PAIR_BLOCKS = SLOTS >> BLOCK_BITS, 1 << (PAIR_BITS - BLOCK_BITS)
STATS = TABLE_BLOCKS + PAIR_BLOCKS  # the block of all adaptive tables
END = 0xFF  # no UTF-8 text has this byte
GATES = 8 * (ORDERS + 1) * 4
#: Bits of a pair's name besides its slot: with 62 in all, no pair is credited with what another one counted.
CHECK_BITS = 40
EXPERTS, WORD_GATES = 3, 6
STATES, BUCKETS = 248, 33
HOT = 1 << 17
CHUNK = 1 << 19
_KEPT_BITS = 22
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CUT = ~SPACED
_CUT[END] = True
#: How sure a count is: 0, 1, 2, 3-4, 5-8, 9-20, 21-60, more.
_SURE = (np.searchsorted([1, 2, 3, 5, 9, 21, 61], np.arange(62), "right") * 31).astype(np.uint8)
#: By predictor and state, the part of a gate that says how long a context was seen and how often: the largest one counts.
_LONGEST = [np.array([(o + 1) * 4 + (s // 31 - 1) // 2 if s >= 31 else 0 for s in range(256)]) for o in range(ORDERS)]
_LOG = np.rint(32 * np.log(np.arange(4096) + 0.4)).astype(np.int16)
_ODDS = np.clip(np.rint((np.arange(1024) - 512) / 16), -15, 15).astype(np.int64).astype(np.int8) + np.int8(15)


class Grams:
    """Symbols in their contexts: the symbol with the four before it (40 bits), and a hash of the word before it."""

    def __init__(self, key: np.ndarray, word: np.ndarray) -> None:
        self.key, self.word = key, word

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, at) -> Grams:
        return Grams(self.key[at], self.word[at])

    def names(self) -> np.ndarray:
        """One 64-bit name for each gram."""
        return mix(self.word) ^ (self.key * np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def join(parts: list[Grams]) -> Grams:
        return Grams(np.concatenate([p.key for p in parts]), np.concatenate([p.word for p in parts]))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[Grams, np.ndarray]:
    """The grams of texts end to end, each text's end symbol included; and where each text's begin."""
    lengths = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    whole = np.full(8 + int(starts[-1]), END, np.uint8)  # a whole 64-bit word before the first
    symbols, real = whole[8:], np.ones(int(starts[-1]), bool)
    real[starts[1:] - 1] = False
    symbols[real] = LOWER.take(data)
    # the eight bytes that end at each place, the last one lowest
    key = np.ndarray(len(symbols), ">u8", whole, 1, (1,)).astype(np.uint64)
    key &= np.uint64((1 << (8 * max(BYTES) + 8)) - 1)
    for inside in range(max(BYTES)):  # no context reaches into the text before: ends stand there
        key[starts[:-1][lengths >= inside] + inside] |= np.uint64((1 << (8 * max(BYTES) + 8)) - (1 << (8 * inside + 8)))
    cuts = np.flatnonzero(_CUT.take(symbols))  # the last symbol is one, an end
    begin = np.concatenate([[0], cuts + 1])[:-1]
    times = cuts + 1 - begin
    value = _BYTE.take(symbols)
    value *= _powers(int(times.max(initial=0)) + 1).take(np.arange(len(symbols)) - np.repeat(begin, times))
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return Grams(key, np.subtract(total[:-1], np.repeat(total[begin], times), out=value)), starts


def distinct(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each name stands for its like, which of those each one is)"""
    bits = min(20, len(name).bit_length() + 1)
    slot = (name >> np.uint64(64 - bits)).view(np.int64)
    table = np.empty(1 << bits, np.int32)
    table[slot] = np.arange(len(name), dtype=np.int32)
    stand = table.take(slot, mode="clip")
    lost = np.flatnonzero(name.take(stand, mode="clip") != name)  # another name stands in their slot
    if len(lost):
        _, first, back = np.unique(name[lost], return_index=True, return_inverse=True)
        stand[lost] = lost[first][back]
    own = np.zeros(len(name), bool)
    own[stand] = True
    at = np.flatnonzero(own)
    number = np.empty(len(name), np.int64)
    number[at] = np.arange(len(at))
    return at, number.take(stand, mode="clip")


def _contexts(g: Grams) -> list[np.ndarray]:
    """Each predictor's context as a 32-bit hash; a decision's slot comes from it and the decisions before."""
    out = [mix(((g.key >> np.uint64(8)) & np.uint64((1 << (8 * o)) - 1)) * np.uint64(8) + np.uint64(o)).astype(np.uint32) for o in BYTES]
    return [*out, mix(g.word + np.uint64(5)).astype(np.uint32)]


def by_contexts(g: Grams, size: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, numbers of their contexts from 0 on) of some size grams at a time; those of the same contexts come together."""
    _, number = distinct(Grams(g.key >> np.uint64(8), g.word).names())
    number = np.sort((number << 32) | np.arange(len(g)))
    places = number & 0xFFFFFFFF
    number >>= 32
    first = np.flatnonzero(np.diff(number, prepend=-1))
    cuts = np.append(first, len(g))[np.unique(np.searchsorted(first, np.arange(0, len(g) + size, size)))].tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield places[a:b], number[a:b] - number[a]


def _slot(o: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = node.astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    h ^= context
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - SLOT_BITS[o])
    at = h.astype(np.int64)
    at += _FROM[o]
    return at


class Code:
    """A binary prefix code of the 256 symbols: for each, the nodes from the root and the branch taken at each."""

    def __init__(self, times: np.ndarray) -> None:
        heap = [(int(n) * 256 + 1, i, i) for i, n in enumerate(times)]
        heapq.heapify(heap)
        parent, branch, new = {}, {}, 256
        while len(heap) > 1:
            (m, _, left), (n, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], branch[left], parent[right], branch[right] = new, 0, new, 1
            heapq.heappush(heap, (m + n, new, new))
            new += 1
        paths = []
        for symbol in range(256):
            path, at = [], symbol
            while at in parent:
                path.append((parent[at] - 256, branch[at]))
                at = parent[at]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        self.node, self.bit = np.zeros((self.length.max(), 256), np.int64), np.zeros((self.length.max(), 256), np.int64)
        for symbol, path in enumerate(paths):
            for level, (node, bit) in enumerate(path):
                self.node[level, symbol], self.bit[level, symbol] = node, bit

    def falling(self, symbol: np.ndarray) -> np.ndarray:
        """The order of symbols in which those with long codes come first, so that at each depth some first ones go on."""
        return np.argsort((255 - self.length).astype(np.uint8).take(symbol), kind="stable")

    def decisions(self, symbol: np.ndarray, number: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """(depth, contexts and nodes of decisions, twice a decision's number plus the branch for each first symbol that goes on)
        of symbols in falling order, each in the contexts of its number. What is decided in the same contexts at one node is one decision."""
        ended = np.cumsum(np.bincount(self.length.take(symbol), minlength=1))
        for level in range(len(ended) - 1):
            n = len(symbol) - int(ended[level])
            if level:
                side = side[:n]
                taken = np.zeros(2 * len(node), bool)
                taken[side] = True
                of = np.flatnonzero(taken)
                number = np.empty(2 * len(node), np.int64)
                number[of] = np.arange(len(of))
                number = number.take(side, mode="clip")
                of >>= 1
                contexts = [c.take(of, mode="clip") for c in contexts]
            node = np.empty(len(contexts[0]), np.int64)
            node[number] = self.node[level].take(symbol[:n])
            side = 2 * number
            side += self.bit[level].take(symbol[:n])
            yield level, contexts, node, side


def _states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    if len(n) and n.max() > 4095:
        shift = np.maximum(0, np.frexp(n)[1] - 12)
        n0, n1 = n0 >> shift, n1 >> shift
    odds = (_LOG[n1] - _LOG[n0]) + np.int16(512)
    return _SURE[np.minimum(n, 61)] + _ODDS[odds].astype(np.uint8)


_SMALL = _states(*np.divmod(np.arange(4096), 64))


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """What a pair of counts tells, as one of STATES: how many there are, and their odds in steps of half a unit."""
    out = _SMALL.take(((n0 & 63) << 6) | (n1 & 63))
    if len(large := np.flatnonzero((n0 | n1) > 63)):
        out[large] = _states(n0[large], n1[large])
    return out


def cuts_and_words(g: Grams, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, place of the cut behind) of each word, in order."""
    cut = _CUT.take(g.key.astype(np.uint8))
    before = np.ones(len(cut), bool)
    before[1:] = cut[:-1]
    first, end = np.flatnonzero(~cut & before), np.flatnonzero(cut & ~before)
    return np.searchsorted(starts, first, "right") - 1, first, end


def pair_keys(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of each word with the word before it in its text, and of the word before alone, from hashes of the words."""
    last = np.full(len(h), np.uint64(0x5BD1E995))
    same = rows[1:] == rows[:-1]
    last[1:][same] = h[:-1][same]
    return mix(mix(last) + h), mix(last ^ np.uint64(0xA5A5A5A5A5A5))


class Mixer:
    """Adaptive tables and mixing weights, as they stand at the start or after learning."""

    def __init__(self) -> None:
        self.weights, self.seen = np.full((GATES, ORDERS + 1), 0.3), np.zeros(GATES, np.int64)
        self.weights[:, ORDERS] = 0
        # how often each state of each predictor, and each bucket of each node, came before a 0 and a 1
        self.met, self.near = np.zeros(ORDERS * 512, np.int64), np.zeros(256 * BUCKETS * 2, np.int64)
        self.shares = np.zeros((WORD_GATES, EXPERTS))
        self.settle()

    def settle(self) -> None:
        """Predictions of states and buckets from what was seen of them so far, and the shares of the words' experts."""
        odds = np.tile((np.arange(31) - 15) / 2, 9)[:256]
        start = 1 / (1 + np.exp(-odds))
        met, near = self.met.reshape(ORDERS, 256, 2), self.near.reshape(256, BUCKETS, 2)
        p = np.clip((met[..., 1] + 8 * start) / (met.sum(axis=2) + 8), 1e-6, 1 - 1e-6)
        self.stretch = np.log(p / (1 - p)).astype(np.float32)
        self.stretch[:, :31] = 0  # a context that was never seen tells nothing
        grid = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
        self.refine = np.clip((near[..., 1] + 8 * grid) / (near.sum(axis=2) + 8), 1e-6, 1 - 1e-6).astype(np.float32)
        prior = np.array([0.6, 0.25, 0.15])
        self.share = (self.shares + 20 * prior) / (self.shares.sum(axis=1, keepdims=True) + 20)

    def stats(self) -> np.ndarray:
        """What is summed over tasks, as whole numbers, so that sums don't depend on their order."""
        weighed = np.rint(self.weights * 2**20).astype(np.int64) * self.seen[:, None]
        return np.concatenate([weighed.ravel(), self.seen, self.met, self.near, np.rint(self.shares * 2**10).astype(np.int64).ravel()])

    @classmethod
    def of(cls, stats: np.ndarray) -> Mixer:
        self = cls()
        sizes = [GATES * (ORDERS + 1), GATES, ORDERS * 512, 256 * BUCKETS * 2, WORD_GATES * EXPERTS]
        weighed, self.seen, self.met, self.near, shares = np.split(stats, np.cumsum(sizes)[:-1])
        known = self.seen > 0
        self.weights[known] = weighed.reshape(GATES, -1)[known] / self.seen[known, None] / 2**20
        self.shares = shares.reshape(WORD_GATES, EXPERTS) / 2**10
        self.settle()
        return self

    def mix(self, state: list[np.ndarray], b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gate, inputs with a bias, mixed value) of decisions at depth b from the states of their contexts."""
        state = [s.astype(np.intp, copy=False) for s in state]
        gate = _LONGEST[0].take(state[0], mode="clip")
        for o in range(1, ORDERS):
            np.maximum(gate, _LONGEST[o].take(state[o], mode="clip"), out=gate)
        gate += min(b, 7) * (ORDERS + 1) * 4
        x = np.full((ORDERS + 1, len(gate)), 0.3, np.float32)
        weights = self.weights.T.astype(np.float32, order="C")
        mixed = weights[ORDERS].take(gate, mode="clip")
        mixed *= np.float32(0.3)
        for o in range(ORDERS):
            part = self.stretch[o].take(state[o], out=x[o], mode="clip") * weights[o].take(gate, mode="clip")
            mixed += part
        np.maximum(mixed, np.float32(-12), out=mixed)
        return gate, x, np.minimum(mixed, np.float32(12), out=mixed)

    def refined(self, node: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, nearest bucket, probability before it is refined) of decisions at nodes of the code."""
        at = np.minimum(np.maximum(mixed, np.float32(-7.999)), np.float32(7.999))
        at *= np.float32(2)
        at += np.float32(16)
        low = np.floor(at)
        at -= low
        slot = node * BUCKETS
        slot += low.astype(np.intp)
        flat = self.refine.reshape(-1)
        below, p = flat.take(slot, mode="clip"), flat[1:].take(slot, mode="clip")
        p -= below
        p *= at
        p += below
        plain = np.exp(-mixed)
        plain += np.float32(1)
        np.reciprocal(plain, out=plain)
        p += plain
        p *= np.float32(0.5)
        np.maximum(p, np.float32(1e-6), out=p)
        slot += at > 0.5
        return np.minimum(p, np.float32(1 - 1e-6), out=p), slot, plain


def _both(p: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of a 0 and of a 1, one after the other for each decision."""
    out = np.empty((len(p), 2), np.float32)
    np.subtract(np.float32(1), p, out=out[:, 0])
    out[:, 1] = p
    return np.log(out, out=out).reshape(-1)


class Pairs:
    """Counts by 64-bit name in a table of fixed size. A name that comes more often in a chunk than a slot's holder has been
    counted takes its slot; a name without a slot counts 0, never what another one counted."""

    def __init__(self, bits: int) -> None:
        self.shift, self.name, self.times = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, name: np.ndarray) -> np.ndarray:
        slot = (name >> self.shift).astype(np.int64)
        return np.where(self.name[slot] == name, self.times[slot], 0)

    def add(self, names: np.ndarray) -> None:
        name, n = np.unique(names, return_counts=True)
        slot = (name >> self.shift).astype(np.int64)
        mine = self.name[slot] == name
        self.times[slot[mine]] += n[mine].astype(np.int32)
        name, n, slot = name[~mine], n[~mine], slot[~mine]
        wins = n > self.times[slot]
        name, n, slot = name[wins], n[wins], slot[wins]
        order = np.argsort(n, kind="stable")  # where several want one slot, the most frequent comes last and stays
        self.name[slot[order]], self.times[slot[order]] = name[order], n[order]


class Learner:
    """One task's counts so far and the mixer that they teach. All is predicted, then counted."""

    def __init__(self, code: Code, cut: np.ndarray) -> None:
        self.code, self.cut, self.mixer = code, cut, Mixer()
        self.table = np.zeros(2 * SLOTS, np.int32)  # of each slot, how many 0s and 1s
        self.state, self.touched = np.full(SLOTS, states(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]), np.zeros(SLOTS, bool)  # what the counts tell
        self.waiting: list[tuple[list[np.ndarray], np.ndarray]] = []  # slots of what was predicted and isn't counted yet, and its 0s and 1s as one number
        # word and pair counts of this task alone, by hash: they only teach the experts' shares
        self.word, self.pair, self.n = np.zeros(1 << 20, np.int32), Pairs(21), 0

    def predict(self, g: Grams, times: np.ndarray, rate: float) -> np.ndarray:
        """log10 of distinct grams' probability; the mixer learns that they occur so many times."""
        m, total, near = self.mixer, np.zeros(len(g)), np.zeros(256 * BUCKETS, np.int64)
        times = times.astype(np.int32)
        for places, number in by_contexts(g):
            symbol = g.key[places].astype(np.uint8)
            order = self.code.falling(symbol)
            contexts = _contexts(g[places[np.flatnonzero(np.diff(number, prepend=-1))]])
            places, symbol = places[order], symbol[order].astype(np.intp)
            n, log = times[places], np.zeros(len(places), np.float32)
            for b, contexts, node, side in self.code.decisions(symbol, number[order], contexts):
                k, each = len(side), np.zeros(2 * len(node), np.int32)
                np.add.at(each, side, n[:k])
                slots = [_slot(o, c, node) for o, c in enumerate(contexts)]
                both = each.view(np.int64)
                self.waiting.append((slots, both))
                gate, x, mixed = m.mix([self.state.take(s, mode="clip") for s in slots], b)
                p, bucket, plain = m.refined(node, mixed)
                log[:k] += _both(p).take(side, mode="clip")
                np.add.at(near, bucket, both)
                ones = each[1::2].astype(np.float32)
                often = ones + each[::2]
                weight = np.bincount(gate, often, GATES)
                m.seen += weight.astype(np.int64)
                step = np.minimum(1.0, 24 / np.maximum(1, weight)) * rate
                plain *= often
                ones -= plain  # what was said beyond what was expected
                for o in range(ORDERS):
                    x[o] *= ones
                    m.weights[:, o] += step * np.bincount(gate, x[o], GATES)
                m.weights[:, ORDERS] += step * 0.3 * np.bincount(gate, ones, GATES)
            total[places] = log
        m.near += near.view(np.int32)
        return total * np.log10(np.e)

    def count(self) -> None:
        """Count all that was predicted since the last time, in the contexts' slots and for the states that told of it."""
        for slots, _ in self.waiting:
            for s in slots:
                self.touched[s] = True
        at, table, m = np.flatnonzero(self.touched), self.table.view(np.int64), self.mixer
        self.touched[at] = False
        before = table[at]
        for slots, both in self.waiting:
            for s in slots:
                np.add.at(table, s, both)
        self.waiting.clear()
        cuts = np.searchsorted(at, _FROM)
        for o, (first, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for i in range(first, end, 1 << 16):
                part = at[i : min(end, i + (1 << 16))]
                now = table[part]
                old, more = self.state[part].astype(np.intp), (now - before[i : i + len(part)]).view(np.int32)
                for bit in (0, 1):
                    m.met[o * 512 + bit : (o + 1) * 512 : 2] += np.bincount(old, more[bit::2], 256).astype(np.int64)
                self.state[part] = states(*now.view(np.int32).reshape(-1, 2).T)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learn from some texts; the names of their pairs of words and of the words before."""
        g, starts = grams(data, offsets)
        first, back = distinct(g.names())
        each, times = g[first], np.bincount(back, minlength=len(first))
        row, begin, end = cuts_and_words(g, starts)
        known = self.predict(each, times, 0.02 / (1 + self.n / 400_000) ** 0.5)
        self.count()
        value = np.concatenate([[0], np.cumsum(known[back])])
        h = g.word[end]
        pair, before = pair_keys(h, row)
        if len(h):
            q = self.cut[(g.key[end] & np.uint64(0xFF)).astype(np.int64)]
            at = (mix(h) >> np.uint64(44)).astype(np.int64)
            seen = self.pair.get(before)
            gate = word_gate(seen)
            chance = np.stack([np.exp(np.log(10) * (value[end + 1] - value[begin])), self.word[at] / max(1, self.n) * q, np.where(seen > 0, np.minimum(1, self.pair.get(pair) / np.maximum(1, seen)), 0) * q])
            chance *= self.mixer.share[gate].T
            chance /= np.maximum(chance.sum(axis=0), 1e-300)
            for k in range(EXPERTS):
                self.mixer.shares[:, k] += np.bincount(gate, chance[k], WORD_GATES)
            np.add.at(self.word, at, np.ones(len(h), np.int32))
            self.pair.add(np.concatenate([pair, before]))
            self.n += len(h)
        self.mixer.settle()
        return pair, before


def word_gate(seen: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 2, 4, 16, 256], seen, "right")


def _pack(counts: np.ndarray) -> bytes:
    """Counts of a block as bytes, those from 255 on apart; only those that aren't 0 if they are few."""
    at = np.flatnonzero(counts)
    few = len(at) * 3 < len(counts)
    kept = counts[at] if few else counts
    large = np.flatnonzero(kept >= 255)
    head = np.array([few, len(at) if few else 0, len(large)], np.uint32).tobytes() + (at.astype(np.uint16).tobytes() if few else b"")
    return head + np.minimum(kept, 255).astype(np.uint8).tobytes() + large.astype(np.uint16).tobytes() + kept[large].astype(np.uint64).tobytes()


def _unpack(data: bytes, width: int = 1 << BLOCK_BITS) -> tuple[np.ndarray, int]:
    """(counts of a block, bytes read)"""
    few, n, m = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    at = np.frombuffer(data, np.uint16, n, 12).astype(np.int64) if few else None
    size, place = (n, 12 + 2 * n) if few else (width, 12)
    kept = np.frombuffer(data, np.uint8, size, place).astype(np.int64)
    kept[np.frombuffer(data, np.uint16, m, place + size)] = np.frombuffer(data[place + size + 2 * m : place + size + 10 * m], np.uint64)
    if few:
        counts = np.zeros(width, np.int64)
        counts[at] = kept
        kept = counts
    return kept, place + size + 10 * m


def _pack_pairs(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys (16 bits of a slot in its block, CHECK_BITS that tell apart what shares it) and their counts."""
    large = np.flatnonzero(n >= 255)
    head = np.array([len(key), len(large)], np.uint32).tobytes()
    parts = (key >> CHECK_BITS).astype(np.uint16), (key & 0xFFFFFFFF).astype(np.uint32), ((key >> 32) & 255).astype(np.uint8), np.minimum(n, 255).astype(np.uint8), large.astype(np.uint32), n[large].astype(np.uint64)
    return head + b"".join(p.tobytes() for p in parts)


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, m = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    at, read = 8, []
    for kind, count in ((np.uint16, size), (np.uint32, size), (np.uint8, size), (np.uint8, size), (np.uint32, m), (np.uint64, m)):
        end = at + count * np.dtype(kind).itemsize
        read.append(np.frombuffer(data[at:end], kind).astype(np.int64))
        at = end
    slot, low, high, n, large, whole = read
    n[large] = whole
    return (slot << CHECK_BITS) | (high << 32) | low, n


def _add_up(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def _pair_place(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, bits that tell apart what shares it)"""
    return (name >> np.uint64(64 - PAIR_BITS)).astype(np.int64), (name & np.uint64((1 << CHECK_BITS) - 1)).astype(np.int64)


BLOCKS = "block long, data binary"


def _learn(code: Code, cut: np.ndarray, batches: Iterator[pa.RecordBatch], flush: int = 1_400_000) -> Iterator[pa.RecordBatch]:
    """One task's counts, a row for each block that has any, and its adaptive tables."""
    learner, held, size, chunk = Learner(code, cut), [], 0, CHUNK >> 3
    row = lambda block, data: pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

    def pairs() -> Iterator[pa.RecordBatch]:
        slot, check = _pair_place(np.concatenate(held))
        key, n = np.unique((slot << CHECK_BITS) | check, return_counts=True)
        cuts = np.searchsorted(key, np.arange(PAIR_BLOCKS + 1) << (BLOCK_BITS + CHECK_BITS))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[k], cuts[k + 1])
            yield row(TABLE_BLOCKS + k, _pack_pairs(key[mine] & ((1 << (BLOCK_BITS + CHECK_BITS)) - 1), n[mine]))

    for batch in batches:
        at = 0
        while at < batch.num_rows:  # small chunks at first, so that soon there is something to predict from
            part = batch.column(0).slice(at)
            _, end, data, offsets = next(chunks(part, chunk))
            at, chunk = at + end, min(CHUNK, chunk + (chunk >> 2))
            found = learner.chunk(data, offsets)
            held += found
            size += len(found[0]) * 2
            if size > flush:
                yield from pairs()
                held, size = [], 0
    if size:
        yield from pairs()
    for block in range(TABLE_BLOCKS):
        part = learner.table[block << (BLOCK_BITS + 1) : (block + 1) << (BLOCK_BITS + 1)].reshape(-1, 2).T
        if part.any():
            yield row(block, b"".join(map(_pack, part)))
    yield row(STATS, learner.mixer.stats().tobytes())


def _sum_blocks(last: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by block. At last, counts become states and each slot of pairs keeps its most frequent one."""
    held: dict[int, list] = {}
    waiting: dict[int, list] = {}
    merged = lambda old, more: [*_add_up(*(np.concatenate(x) for x in zip(old, *more, strict=True)))]
    for part in batches:
        for block, data in zip(part["block"].tolist(), part["data"], strict=True):
            if block < TABLE_BLOCKS:
                n0, read = _unpack(data)
                new = [n0, _unpack(data[read:])[0]]
            elif block < STATS:
                new = [*_unpack_pairs(data)]
            else:
                new = [np.frombuffer(data, np.int64)]
            if (old := held.get(block)) is None:
                held[block] = new
            elif TABLE_BLOCKS <= block < STATS:
                waiting.setdefault(block, []).append(new)
                if sum(len(w[0]) for w in waiting[block]) > 2 * len(old[0]) + 50_000:
                    held[block] = merged(old, waiting.pop(block))
            else:
                held[block] = [x + y for x, y in zip(old, new, strict=True)]
    for block, sums in held.items():
        if block == STATS:
            data = sums[0].tobytes()
        elif block < TABLE_BLOCKS:
            data = states(*sums).tobytes() if last else b"".join(map(_pack, sums))
        else:
            key, n = merged(sums, waiting.get(block, []))
            if last:
                order = np.lexsort((key, -n, key >> CHECK_BITS))
                keep = np.sort(order[np.unique(key[order] >> CHECK_BITS, return_index=True)[1]])
                key, n = key[keep], n[keep]
            data = _pack_pairs(key, n)
        yield pd.DataFrame({"block": [block], "data": [data]})


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs, and, as a 257th, words."""
    times = np.zeros(257, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            times[:256] += np.bincount(LOWER[data], minlength=256)
            times[END] += len(offsets) - 1
            inside = np.append(SPACED[data], False)
            starts = inside[:-1].copy()
            starts[1:] &= ~inside[:-2]
            opens = offsets[:-1][np.diff(offsets) > 0]
            times[256] += np.count_nonzero(starts) + np.count_nonzero(inside[opens] & ~starts[opens])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(times)], names=["at", "n"])


class ContextModel:
    """All that scoring needs, of fixed size: states of contexts, the mixer, frequent pairs of words."""

    def __init__(self, code: Code, cut: np.ndarray, n_words: int, blocks: dict[int, bytes]) -> None:
        self.code, self.cut, self.n_words = code, cut, n_words
        self.mixer = Mixer.of(np.frombuffer(blocks[STATS], np.int64)) if STATS in blocks else Mixer()
        self.state = np.full(SLOTS, 15, np.uint8)
        self.low, self.high, self.times = np.zeros(1 << PAIR_BITS, np.uint32), np.zeros(1 << PAIR_BITS, np.uint8), np.zeros(1 << PAIR_BITS, np.int32)
        for block, data in blocks.items():
            if block < TABLE_BLOCKS:
                self.state[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(data, np.uint8)
            elif block < STATS:
                key, n = _unpack_pairs(data)
                slot = ((block - TABLE_BLOCKS) << BLOCK_BITS) + (key >> CHECK_BITS)
                self.low[slot], self.high[slot], self.times[slot] = key & 0xFFFFFFFF, (key >> 32) & 255, np.minimum(n, 2**31 - 1)

    def log10(self, g: Grams) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its contexts."""
        symbol = g.key.astype(np.uint8)
        out, order = np.zeros(len(g)), self.code.falling(symbol)
        symbol = symbol[order].astype(np.intp)
        lengths = self.code.length.take(symbol)
        for at in range(0, len(g), 16384):
            places, said = order[at : at + 16384], symbol[at : at + 16384]
            contexts, total = _contexts(g[places]), np.zeros(len(places), np.float32)
            for b in range(int(lengths[at])):
                k = int(np.searchsorted(-lengths[at : at + 16384], -b, "left"))
                node = self.code.node[b].take(said[:k])
                state = [self.state.take(_slot(o, c[:k], node), mode="clip") for o, c in enumerate(contexts)]
                p, *_ = self.mixer.refined(node, self.mixer.mix(state, b)[2])
                ones = self.code.bit[b].take(said[:k]).astype(np.float32)  # p of a 1, 1 - p of a 0
                ones -= np.float32(1)
                ones += p
                total[:k] += np.log(np.abs(ones, out=ones), out=ones)
            out[places] = total
        return out * np.log10(np.e)

    def pairs(self, name: np.ndarray) -> np.ndarray:
        """Exact counts of the names that hold their slot, 0 of others; so what followed a word sums to its count at most."""
        slot, check = _pair_place(name)
        return np.where((self.low[slot] == (check & 0xFFFFFFFF)) & (self.high[slot] == check >> 32), self.times[slot], 0)


class Scorer:
    """Scores of texts. Grams' values are kept in a table of fixed size, as the model no longer changes."""

    def __init__(self, model: ContextModel) -> None:
        self.model = model
        self.name = np.full(1 << _KEPT_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(1 << _KEPT_BITS, np.float32)

    def values(self, g: Grams) -> np.ndarray:
        name = g.names()
        slot = (name >> np.uint64(64 - _KEPT_BITS)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.name[slot] != name)
        if len(miss):
            first, back = distinct(name[miss])
            found = self.model.log10(g[miss[first]]).astype(np.float32)
            out[miss] = found[back]
            new = miss[first]
            self.name[slot[new]], self.value[slot[new]] = name[new], found
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: log10 of what isn't in words. For each word: log10 of its probability but for its
        exact count, and log10 of what a share of 1 of all words there would add, by that probability."""
        m, (g, starts) = self.model, grams(data, offsets)
        value = np.concatenate([[0], np.cumsum(np.concatenate([self.values(g[at : at + (1 << 18)]) for at in range(0, len(g), 1 << 18)]), dtype=np.float64)])
        row, begin, end = cuts_and_words(g, starts)
        said = value[end + 1] - value[begin]
        pair, before = pair_keys(g.word[end], row)
        seen = m.pairs(before)
        share = m.mixer.share[word_gate(seen)]
        q = m.cut[(g.key[end] & np.uint64(0xFF)).astype(np.int64)]
        both = share[:, 0] * np.exp(np.log(10) * np.maximum(said, -280)) + np.where(seen > 0, np.minimum(1, m.pairs(pair) / np.maximum(1, seen)), 0) * share[:, 2] * q
        # What isn't a word but a cut after a cut is said by the contexts alone, with their share at a word's place.
        alone = np.bincount(row, said, len(offsets) - 1)
        cuts = np.diff(starts) - np.bincount(row, end - begin + 1, len(offsets) - 1)
        rest = value[starts[1:]] - value[starts[:-1]] - alone + cuts * np.log10(m.mixer.share[:, 0].min())
        return rest, np.log10(both), np.log10(share[:, 1] * q) - np.log10(both)


def train(docs: DataFrame, text: str = "text") -> ContextModel:
    """A model from all texts of docs: all of them moves the mixer and is counted.

    Null texts count as empty ones. Without rows, every decision has even odds.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"))
    times = np.zeros(257, np.int64)
    for r in source.mapInArrow(_count_bytes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 257 rows
        times[r["at"]] = r["n"]
    code = Code(times[:256])
    cut = np.where(_CUT, times[:256] + 0.1, 0)
    cut /= cut.sum()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("data"), F.lit(max(1, n // 16)))  # of the rows alone, so that a repeated task deals as before
    first = source.mapInArrow(partial(_learn, code, cut), BLOCKS).repartition(n, "block", salt).mapInPandas(partial(_sum_blocks, False), BLOCKS)
    summed = stage(first.repartition(n, "block").mapInPandas(partial(_sum_blocks, True), BLOCKS), "model")
    model = ContextModel(code, cut, int(times[256]), {r["block"]: bytes(r["data"]) for r in summed.toLocalIterator()})  # STATS + 1 rows
    unstage(summed)
    return model


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: ContextModel) -> Scorer:
    if (found := _SCORERS.get(id(model))) is None:
        _SCORERS.clear()
        found = _SCORERS[id(model)] = Scorer(model)
    return found


def _word_counts(batches: Iterator[pa.RecordBatch], flush: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Distinct word hashes of some texts with how often each occurs in them and in those for training, by hash range."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        h, out = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        h, every = np.unique(h, return_counts=True)
        out, times = np.unique(out, return_counts=True)
        taught = every.copy()
        taught[np.searchsorted(h, out)] -= times
        return _by_shard(h, {"n": every.astype(np.uint32), "c": taught.astype(np.uint32)})

    for batch in batches:
        taught = np.asarray(batch.column(1).to_pylist(), bool)
        for a, _, data, offsets in chunks(batch.column(0)):
            rows, h, _ = words(data, offsets, SPACED)
            held.append((h, h[~taught[a + rows]]))
            size += len(h)
            if size > flush:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


_SHARD_BITS = 10


def _by_shard(h: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each of 2 ** _SHARD_BITS ranges of the sorted hashes h."""
    cuts = np.searchsorted(h, np.arange(1, 1 << _SHARD_BITS, dtype=np.uint64) << np.uint64(64 - _SHARD_BITS))
    cuts = np.concatenate([[0], cuts, [len(h)]])
    at = np.flatnonzero(np.diff(cuts))
    columns = {"hash": h} | values
    return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in at], pa.binary()) for v in columns.values())], names=["shard", *columns])


def _sum_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by hash of each shard in a partition; held sums are merged whenever their rows have doubled."""
    held: dict[int, list] = {}

    def merge(parts: list) -> tuple:
        h = np.concatenate([p[0] for p in parts])
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], first) for k in (1, 2))

    for part in batches:
        for r in part.itertuples(index=False):
            parts = held.setdefault(r.shard, [])
            parts.append((np.frombuffer(r.hash, np.uint64), *(np.frombuffer(x, np.uint32).astype(np.uint64) for x in (r.n, r.c))))
            if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > 2 * len(parts[0][0]) + 500_000:
                held[r.shard] = [merge(parts)]
    for shard, parts in held.items():
        h, n, c = merge(parts)
        yield pd.DataFrame({"shard": [shard], "hash": [h.tobytes()], "n": [n.tobytes()], "c": [c.tobytes()], "words": [len(h)], "all_n": [int(n.sum())], "all_c": [int(c.sum())], "known": [int((c > 0).sum())]})


def _score(sent, hot, batches: Iterator[pa.RecordBatch], flush: int = 700_000) -> Iterator[pa.RecordBatch]:
    """A row for each text: its score and base but for what rare words' counts add; and packed rows of those words."""
    hot_hash, hot_c, floor, scale = hot.value
    scorer = _scorer(sent.value)
    n_words = max(1, sent.value.n_words)
    serial, task = 0, TaskContext.get().partitionId()
    names = ["doc_id", "row", "n_tokens", "n_bytes", "known", "base", "score", "shard", "hash", "times", "rows", "odds"]
    kinds = [*[pa.int64()] * 5, pa.float64(), pa.float64(), pa.int64(), *[pa.binary()] * 4]
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        """By shard: distinct hashes, how often each occurs, then in which texts and what its count would add there."""
        h, row, odds = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((row, h))
        h, row, odds = h[order], row[order], odds[order].astype(np.float32)
        cuts = np.searchsorted(h, np.arange(1, 1 << _SHARD_BITS, dtype=np.uint64) << np.uint64(64 - _SHARD_BITS))
        cuts = np.concatenate([[0], cuts, [len(h)]])
        out = {c: [] for c in names[7:]}
        for s in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[s], cuts[s + 1])
            first = np.flatnonzero(np.concatenate([[True], h[mine][1:] != h[mine][:-1]]))
            base = int(row[mine].min())
            values = (int(s), h[mine][first].tobytes(), np.diff(np.append(first, cuts[s + 1] - cuts[s])).astype(np.uint32).tobytes(), np.int64(base).tobytes() + (row[mine] - base).astype(np.uint32).tobytes(), odds[mine].tobytes())
            for c, v in zip(names[7:], values, strict=True):
                out[c].append(v)
        n = len(out["shard"])
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:7]), *(pa.array(out[c], k) for c, k in zip(names[7:], kinds[7:], strict=True))], names=names)

    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1), CHUNK):
            rows, h, _ = words(data, offsets, SPACED)
            score, said, odds = scorer.score(data, offsets)
            ids = (task << 36) + serial + np.arange(b - a)
            serial += b - a
            slot = np.minimum(np.searchsorted(hot_hash, h), max(0, len(hot_hash) - 1))
            frequent = hot_hash[slot] == h if len(hot_hash) else np.zeros(len(h), bool)
            c = hot_c[slot[frequent]] if len(hot_hash) else np.zeros(0)
            said[frequent] += np.log10(1 + c / n_words * 10 ** odds[frequent])
            score += np.bincount(rows, said, b - a)
            base = np.bincount(rows[frequent], np.log10((c + 0.1) / scale), b - a) + floor  # floor: the end token's
            known = np.bincount(rows[frequent], c > 0, b - a)
            n_tokens = np.bincount(rows, minlength=b - a) + 1
            columns = (ids, n_tokens, np.diff(offsets) + 1, known.astype(np.int64), base, score)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns), *(pa.nulls(b - a, k) for k in kinds[7:])], names=names)
            held.append((h[~frequent], ids[rows[~frequent]], odds[~frequent]))
            size += len(held[-1][0])
            if size > flush:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


def _add_rare(scale: float, n_words: int):
    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """What one shard's words add to the base and the score of each text that holds them."""
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in counts["hash"]]) if len(counts) else np.zeros(0, np.uint64)
        c = np.concatenate([np.frombuffer(x, np.uint64) for x in counts["c"]]) if len(counts) else np.zeros(0, np.uint64)
        out = []
        for r in asked.itertuples(index=False):
            each = np.repeat(c[np.searchsorted(h, np.frombuffer(r.hash, np.uint64))].astype(np.float64), np.frombuffer(r.times, np.uint32))
            which, back = np.unique(np.frombuffer(r.rows, np.uint32, offset=8), return_inverse=True)
            more = np.log10(1 + each / n_words * 10 ** np.frombuffer(r.odds, np.float32).astype(np.float64))
            sums = (np.bincount(back, x) for x in (each > 0, np.log10((each + 0.1) / scale), more))
            out.append((which.astype(np.int64) + np.frombuffer(r.rows[:8], np.int64)[0], *sums))
        if not out:
            return pd.DataFrame({"row": [], "known": [], "base": [], "more": []})
        row, *sums = (np.concatenate(x) for x in zip(*out, strict=True))
        which, back = np.unique(row, return_inverse=True)
        known, base, more = (np.bincount(back, x) for x in sums)
        return pd.DataFrame({"row": which, "known": known.astype(np.int64), "base": base, "more": more})

    return run


def score(docs: DataFrame, folds: int = 10, text: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Rows whose crc32 of doc_id mod folds isn't 0 teach the counts and the model. Null texts count as empty: one token,
    the end. Repeated rows are scored each. A null doc_id is never held out. Extra columns are ignored. An empty table
    gives no rows. Words are told apart by 64-bit hashes. bits_per_byte counts the end as a byte.
    """
    spark = docs.sparkSession
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    taught = remainder(F.col("doc_id"), folds) != 0
    model = train(source.where(taught))
    sent = spark.sparkContext.broadcast(model)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = source.select("text", taught.alias("taught")).mapInArrow(_word_counts, "shard long, hash binary, n binary, c binary")
    sums = counted.repartition(n, "shard").mapInPandas(_sum_words, "shard long, hash binary, n binary, c binary, words long, all_n long, all_c long, known long")
    sums = stage(sums, "words")
    totals = sums.agg(F.sum("all_n").alias("n"), F.sum("all_c").alias("c"), F.sum("known").alias("v")).first()
    ends = source.where(taught).count()
    train_tokens, kinds = (totals["c"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    scale = train_tokens + 0.1 * (kinds + 1)
    often = max(1.0, (totals["n"] or 0) / HOT)  # at most HOT words occur so often

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples(index=False):
                h, m, c = (np.frombuffer(x, np.uint64) for x in (r.hash, r.n, r.c))
                keep = m > often
                if keep.any():
                    yield pd.DataFrame({"hash": h[keep].view(np.int64), "c": c[keep].astype(np.int64)})

    top = sums.mapInPandas(frequent, "hash long, c long").collect()
    hot_hash = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hot_hash)
    hot = spark.sparkContext.broadcast((hot_hash[order], np.array([r["c"] for r in top], np.float64)[order], float(np.log10((ends + 0.1) / scale)), scale))
    shape = "doc_id long, row long, n_tokens long, n_bytes long, known long, base double, score double, shard long, hash binary, times binary, rows binary, odds binary"
    found = stage(source.mapInArrow(partial(_score, sent, hot), shape), "scored")
    asked = found.where(F.col("shard").isNotNull()).select(F.col("shard").alias("in_shard"), "hash", "times", "rows", "odds")
    rare = asked.groupBy("in_shard").cogroup(sums.select("shard", "hash", "c").groupBy("shard")).applyInPandas(_add_rare(scale, max(1, model.n_words)), "row long, known long, base double, more double")
    rare = rare.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("more").alias("more_score"))
    rows = found.where(F.col("shard").isNull()).join(rare, "row", "left")
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return rows.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
