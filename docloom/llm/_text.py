"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space (0x20, 0x09-0x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 19
#: What a Python worker keeps between tasks of one step, and the step that its last task was of.
KEPT: list[dict] = []
_STEP_OF: list[str] = [""]


def begin(step: str) -> None:
    """As a task of a step begins: what tasks of other steps left in this Python worker goes, back to the system."""
    if _STEP_OF[0] == step:
        return
    _STEP_OF[0] = step
    for kept in KEPT:
        kept.clear()
    release()


def release() -> None:
    """What this process no longer refers to goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, _kept: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(_kept[0]) < n:
        full = np.full(max(n, 256), _STEP, np.uint64)
        full[0] = 1
        grown = np.multiply.accumulate(full)
        if n > 1 << 20:  # a huge word's powers aren't worth keeping
            return grown
        _kept[0] = grown
    return _kept[0]


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, end, bytes, offsets) of some chunk_bytes each, so that temporary arrays stay small.

    A null text has no bytes; a text longer than chunk_bytes is a chunk of its own, whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null's slot may span bytes
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(at), 0)
        data = np.concatenate([data[a : a + m] for a, m in zip(at[:-1], lengths, strict=True)]) if n else data
        at = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + chunk_bytes, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, length in bytes) of each word, in text order; A-Z count as a-z unless fold is off."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none.astype(np.uint64), none
    data = LOWER[data] if fold else data
    here = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, here[:-1]
    start = np.flatnonzero(here & (~before | cut[:-1]))
    if not len(start):
        return none, none.astype(np.uint64), none
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, here[1:]
    end = np.flatnonzero(here & (~after | cut[1:])) + 1
    lengths = end - start
    total = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    values = _BYTE[data[here]]
    values *= _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, total[:-1]))
    return np.searchsorted(offsets, start, "right") - 1, hashes, lengths


def runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in the sorted array rows, and its end."""
    return np.searchsorted(rows, np.arange(n + 1))
