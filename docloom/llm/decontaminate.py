"""Benchmark decontamination with suffix arrays of the training texts.

Each shard (half a megabyte of whole documents inside a task) gets a suffix array over its words: its word positions in
the order of all the words that follow them, up to the document's end or the first word that no test has. Only positions
that can begin a match are kept, which are those followed by as many benchmark words as the shortest window has. Every
suffix of every benchmark item that begins a window is binary-searched in every shard's array; each occurrence that can't
be extended to the left is extended to the right, which gives the longest verbatim matches with their locations.

The benchmark goes to tasks in blocks of at most ``block_words`` words, each block against all documents, so what is
broadcast is bounded however large the benchmark is. Matches are written beside the row that they were found in, so rows
need no identity and nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._split import append_columns, free_name
from docloom.llm._text import ALNUM, begin, chunks, words
from docloom.storage import stage

WINDOW = 10
MATCH = "array<struct<item_id:string,doc_start:bigint,item_start:bigint,length:bigint>>"
_KEY = ">u4"


@dataclass
class Tests:
    """A block of benchmark items: its vocabulary as sorted hashes, its words as numbers from 1, its suffixes' heads."""

    items: list[str | None]
    vocabulary: np.ndarray
    words: np.ndarray  # all items' words, end to end
    first: np.ndarray  # where each item's words begin, and the end
    keys: np.ndarray  # the first words of suffixes, sorted; shorter items' padded with 0
    sizes: np.ndarray  # words in each key
    owner: np.ndarray  # item and place of each suffix
    place: np.ndarray


def _keys(numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int) -> np.ndarray:
    """The next ``window`` word numbers from each start, 0 from its stop on, as byte strings in the order of the numbers."""
    at = starts[:, None] + np.arange(window)[None, :]
    inside = at < stops[:, None]
    return np.ascontiguousarray(np.where(inside, numbers[np.minimum(at, len(numbers) - 1)], 0).astype(_KEY)).view(f"S{4 * window}").ravel()


def build_tests(items: list[tuple[str | None, str]], window: int = WINDOW) -> Tests:
    parts = [(rows + a, hashes) for a, _, data, offsets in chunks(pa.array([t for _, t in items], pa.string())) for rows, hashes, _ in [words(data, offsets, ALNUM)]]
    rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int64)
    vocabulary, numbers = np.unique(np.concatenate([h for _, h in parts]) if parts else np.zeros(0, np.uint64), return_inverse=True)
    numbers, first = numbers.astype(np.int64) + 1, np.searchsorted(rows, np.arange(len(items) + 1))
    size = np.minimum(window, np.diff(first))[rows]
    starts = np.flatnonzero(first[rows + 1] - np.arange(len(rows)) >= size)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Tests([], vocabulary, none, np.zeros(1, np.int64), np.zeros(0, f"S{4 * window}"), none, none, none)
    keys = _keys(numbers, starts, starts + size[starts], window)
    order = np.argsort(keys, kind="stable")
    starts = starts[order]
    return Tests([i for i, _ in items], vocabulary, numbers, first, keys[order], size[starts], rows[starts], starts - first[rows[starts]])


def suffix_array(numbers: np.ndarray, rows: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words as sorted keys, positions), in suffix order, of suffixes that begin with ``least`` known words.

    numbers: 0 for a word that no test has. A suffix ends before such a word and at its document's end; equal suffixes are
    in the order of their positions. Order by the first ``window`` words is refined by doubling, on ties alone.
    """
    n = len(numbers)
    here = np.arange(n)
    stop = np.minimum.accumulate(np.where(numbers == 0, here, n)[::-1])[::-1]
    stop = np.minimum(stop, np.searchsorted(rows, rows, "right"))
    begins = np.ones(n, bool)
    begins[1:] = stop[1:] != stop[:-1]
    run = np.maximum.accumulate(np.where(begins, here, 0))
    at = np.flatnonzero((numbers > 0) & (stop - run >= least))  # all places of runs that are long enough
    if not len(at):
        return np.zeros(0, f"S{4 * window}"), at
    keys = _keys(numbers, at, stop[at], window)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    rank, slots, step = np.zeros(n + 1, np.int64), np.arange(len(at)), window
    rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
    while True:
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        tied = tied[stop[at[tied]] - at[tied] > step]
        if not len(tied):
            break
        group = np.unique(rank[at[tied]])
        tied = np.flatnonzero(np.isin(rank[at], group))
        mine = at[tied]
        after = np.where(stop[mine] - mine > step, rank[np.minimum(mine + step, n)], 0)
        order = np.lexsort((mine, after, rank[mine]))
        at[tied], after = mine[order], after[order]
        changed = np.ones(len(tied), bool)
        changed[1:] = (np.diff(rank[at[tied]]) != 0) | (np.diff(after) != 0)
        fresh[tied] = changed
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        step *= 2
    begin = stop[at] - at >= least
    return keys[begin], at[begin]


def search(tests: Tests, keys: np.ndarray, positions: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, training position) of all verbatim occurrences of suffixes' heads, by binary search."""
    low = np.searchsorted(keys, tests.keys, "left")
    high = np.searchsorted(keys, tests.keys, "right")
    for i in np.flatnonzero(tests.sizes < window):  # a short item matches all suffixes that it begins
        head = tests.keys[i].ljust(4 * window, b"\0")[: 4 * tests.sizes[i]]
        high[i] = np.searchsorted(keys, np.bytes_(head + b"\xff" * (4 * window - len(head))), "right")
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    which = np.repeat(found, count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, positions[np.repeat(low[found], count) + step]


def extend(tests: Tests, which: np.ndarray, at: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, training start, item start, words) of longest matches: occurrences with no word before that matches too."""
    ends, starts = np.searchsorted(rows, rows[at], "right"), np.searchsorted(rows, rows[at])
    said = tests.first[tests.owner[which]] + tests.place[which]
    left = (tests.place[which] > 0) & (at > starts)
    left[left] = numbers[at[left] - 1] == tests.words[said[left] - 1]
    which, at, ends, said = which[~left], at[~left], ends[~left], said[~left]
    over, length = tests.first[tests.owner[which] + 1], tests.sizes[which].copy()
    going = np.arange(len(at))
    while len(going):
        going = going[(said[going] + length[going] < over[going]) & (at[going] + length[going] < ends[going])]
        going = going[tests.words[said[going] + length[going]] == numbers[at[going] + length[going]]]
        length[going] += 1
    return tests.owner[which], at, tests.place[which], length


def _matches(window: int, name: str, sent, texts: pa.Array) -> dict[str, list]:
    begin("decontaminate")
    tests, counted, found = sent.value, [], []
    least = int(tests.sizes.min()) if len(tests.sizes) else 1
    for a, b, data, offsets in chunks(texts):
        rows, hashes, _ = words(data, offsets, ALNUM)
        counted += np.bincount(rows, minlength=b - a).tolist()
        mine: list[list] = [[] for _ in range(b - a)]
        if len(tests.keys) and len(hashes):
            slot = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
            numbers = np.where(tests.vocabulary[slot] == hashes, slot + 1, 0)
            item, at, place, length = extend(tests, *search(tests, *suffix_array(numbers, rows, least, window), window), numbers, rows)
            start = at - np.searchsorted(rows, rows[at])
            order = np.lexsort((item, start, rows[at]))
            for r, i, s, p, m in zip(*(x[order].tolist() for x in (rows[at], item, start, place, length)), strict=True):
                mine[r].append({"item_id": tests.items[i], "doc_start": s, "item_start": p, "length": m})
        found += mine
    return {f"{name}_words": counted, name: found}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items, some at a time; an empty block if there are none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where(F.col("t").isNotNull())
    block, size, given = [], 0, False
    for r in items.toLocalIterator():
        if block and size + len(r.t) // 2 > block_words:
            yield block
            block, size, given = [], 0, True
        block.append((r.i, r.t))
        size += len(r.t) // 2
    if block or not given:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000, text: str = "text") -> DataFrame:
    """docs with n_words and matches, in place: each row's longest verbatim matches of at least a window.

    A match has item_id, doc_start, item_start and length (in words from 0). Rows keep their other columns, whatever they
    repeat; columns named n_words or matches are replaced. A null text has no words. An item without words matches
    nothing; an item shorter than the window matches whole. Items of a null item_id match like others, with a null there;
    items that repeat an item_id count as one item.

    A benchmark of one block (``block_words``) is one pass over docs. A larger one is a pass for each block: rows are
    numbered once, each block's matches are written, and its broadcast goes before the next one comes; rows come back in
    their order.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "matches")]
    source = docs.select(*[docs[c] for c in kept])
    name = free_name(kept, "__found")
    kind = T.StructType.fromDDL(f"{name}_words bigint, {name} {MATCH}")

    def against(rows: DataFrame, block: list[tuple[str | None, str]]):
        sent = spark.sparkContext.broadcast(build_tests(block, window))
        return append_columns(rows, text, partial(_matches, window, name, sent), kind), sent

    blocks = _blocks(benchmark, block_words)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return against(source, block)[0].select(*kept, F.col(f"{name}_words").alias("n_words"), F.col(name).alias("matches"))
    row = free_name([*kept, name], "__row")
    rows = stage(source.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = []
    for number, block in enumerate(itertools.chain([block, after], blocks)):
        found, sent = against(rows.select(row, text), block)
        found = found.select(row, F.col(f"{name}_words").alias("n"), F.lit(number).alias("number"), F.col(name).alias("m"))
        parts.append(stage(found if number == 0 else found.where(F.size("m") > 0), "matches"))
        sent.destroy()
    union = reduce(DataFrame.unionByName, parts)
    held = union.groupBy(row).agg(F.max(F.when(F.col("number") == 0, F.col("n"))).alias(f"{name}_words"), F.sort_array(F.collect_list(F.struct("number", "m"))).alias(name))
    every = F.flatten(F.transform(name, lambda x: x["m"]))
    return rows.join(held, row).orderBy(row).select(*kept, F.col(f"{name}_words").alias("n_words"), every.alias("matches"))


def _covered(matches: F.Column) -> F.Column:
    """Words inside any match; matches by falling start are merged from the left."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("start"), (m["doc_start"] + m["length"]).alias("end"))))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        fresh = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["end"], s["start"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_hit (words inside matches), n_items, items_sha256 and contaminated (n_hit > 0).

    Null and empty texts have no words and aren't contaminated; no benchmark leaves all documents clean. Rows that
    repeat a doc_id, or have none, each get their own result. An item without item_id counts as one item that
    items_sha256 doesn't name. An empty table gives no rows.
    """
    found = find_matches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")), benchmark, window)
    items = F.array_distinct(F.transform("matches", lambda m: m["item_id"]))
    return found.select(
        "doc_id",
        "n_words",
        _covered(F.col("matches")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.filter(items, lambda i: i.isNotNull())), ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose own text holds a benchmark window; all others stay, whatever their ids."""
    names = {c: free_name([*docs.columns, "n_words", "matches"], f"_{c}") for c in docs.columns if c.lower() in ("n_words", "matches") and c != text}
    plain = docs.withColumnsRenamed(names)
    out = find_matches(plain, benchmark, window, text=text).where(F.size("matches") == 0)
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
