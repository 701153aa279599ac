"""Exact duplicates by tree-merging sorted runs of digests.

Each partition of the table makes a run: its rows' keys in order, equal ones already one entry (longest text, smallest id,
number of rows). Runs are then exchanged in rounds: in each, the runs whose numbers differ only in one digit (to the base 32)
are a group, every run is cut at 32 bounds of the key space, and each member of the group gets one slice from all of them and
merges them. After as many rounds as the number of runs has digits, run s holds all entries of slice s of the key space. That
is the binomial exchange with 32 partners a round in place of 2. A key that a third of all rows share is one entry in each run
from the start, and a 32nd as many after each round; nothing gathers in one task.

Entries travel as blocks, sorted, of at most 4,096. A merge reads blocks in the order of their first keys and holds the blocks
that still overlap, at most two from each run that it merges, so its memory doesn't grow with the runs.

A key is the sha256 of the text without white space, that text's length in bytes and a 64-bit hash of it by another function.
Entries are one only if all three agree, at every level.

Defined results. A null text counts as empty; empty texts, and texts of white space, are equal. A null id ranks behind all
numbers. Of rows with equal text, length and id one stays. Texts of any length are hashed whole. An empty table has no rows.
Other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import stage

FAN = 32
BLOCK = 4096
#: Sort order: key, then the row that stays first.
ENTRY = np.dtype([("key", "<u8", 6), ("chars", "<i8"), ("null", "u1"), ("id", "<i8"), ("row", "<i8"), ("rows", "<i8")])
_BLOCKS = "dest long, first binary, entries binary"


def _sorted(entries: np.ndarray) -> np.ndarray:
    """entries by key, one for each: of equal keys the row that stays, with the sum of their rows."""
    if not len(entries):
        return entries
    k = entries["key"]
    order = np.lexsort((entries["row"], entries["id"], entries["null"], -entries["chars"], *(k[:, i] for i in range(5, -1, -1))))
    entries = entries[order]
    k = entries["key"]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
    out = entries[first]
    out["rows"] = np.add.reduceat(entries["rows"], first)
    return out


def _below(entries: np.ndarray, bound: tuple[int, ...]) -> int:
    """How many of the sorted entries have a key below bound."""
    low, high = 0, len(entries)
    while low < high:
        mid = (low + high) // 2
        if tuple(entries["key"][mid].tolist()) < bound:
            low = mid + 1
        else:
            high = mid
    return low


def merged(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted union (run, entries) of sorted blocks, which come by run and first key.

    Entries below the first key of the next block are complete. Merging waits until as much is new as was left over.
    """
    run, held, fresh, left = None, [], 0, 0
    for dest, block in blocks:
        if dest != run:
            if held:
                yield run, _sorted(np.concatenate(held))
            run, held, fresh, left = dest, [], 0, 0
        if fresh > max(left, BLOCK):
            pool = _sorted(np.concatenate(held))
            cut = _below(pool, tuple(block["key"][0].tolist()))
            if cut:
                yield run, pool[:cut]
            held, fresh, left = [pool[cut:]], 0, len(pool) - cut
        held.append(block)
        fresh += len(block)
    if held:
        yield run, _sorted(np.concatenate(held))


def _cut(runs: Iterator[tuple[int, np.ndarray]], step: int, rounds: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices (run to send to, entries) of at most a block, for the round ``step``: the digit of that round gives way to the key's."""
    weight = FAN ** (rounds - 1 - step)
    bits = np.uint64(64 - 5 * (step + 1))
    for run, entries in runs:
        digit = (entries["key"][:, 0] >> bits).astype(np.int64) % FAN
        starts = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(entries)], strict=True):
            dest = run + (int(digit[a]) - run // weight % FAN) * weight
            for i in range(a, b, BLOCK):
                yield dest, entries[i : min(b, i + BLOCK)]


def _packed(slices: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows; small slices to one run that follow each other are one block."""
    kept: dict[int, list[np.ndarray]] = {}
    rows: list[tuple[int, bytes, bytes]] = []

    def put(dest: int) -> None:
        entries = np.concatenate(kept.pop(dest))
        rows.append((dest, entries["key"][0].astype(">u8").tobytes(), entries.tobytes()))

    def batch() -> pa.RecordBatch:
        dests, firsts, data = zip(*rows, strict=True)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(dests, pa.int64()), pa.array(firsts, pa.binary()), pa.array(data, pa.binary())], ["dest", "first", "entries"])

    for dest, entries in slices:
        for other in [d for d in kept if d != dest]:
            put(other)
        kept.setdefault(dest, []).append(entries)
        if sum(map(len, kept[dest])) >= BLOCK:
            put(dest)
        if len(rows) >= 32:
            yield batch()
    for dest in list(kept):
        put(dest)
    if rows:
        yield batch()


def _from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of entries of rows (run, key, chars, id, row); a batch's rows of a run are a block."""
    for b in batches:
        if not b.num_rows:
            continue
        out = np.zeros(b.num_rows, ENTRY)
        out["key"] = np.frombuffer(b"".join(b["key"].to_pylist()), ">u8").reshape(-1, 6)
        out["chars"], out["row"], out["rows"] = b["chars"].to_numpy(), b["row"].to_numpy(), 1
        out["null"] = np.asarray(b["id"].is_null())
        out["id"] = b["id"].fill_null(0).to_numpy()
        run = b["run"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        for i, j in zip(cuts, [*cuts[1:], len(run)], strict=True):
            yield int(run[i]), _sorted(out[i:j])


def _from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for dest, entries in zip(b["dest"].to_pylist(), b["entries"], strict=True):
            yield dest, np.frombuffer(entries.as_py(), ENTRY)


def winners(keyed: DataFrame, runs: int) -> DataFrame:
    """(key, keep_row, keep_id, group_size) of rows (run, key, chars, id, row), run from 0 to runs - 1."""
    rounds = 1
    while FAN**rounds < runs:
        rounds += 1
    if rounds > 12:
        raise ValueError("too many runs")

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(_cut(_from_rows(batches), 0, rounds))

    def exchange(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed(_cut(merged(_from_blocks(batches)), step, rounds))

        return run

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, e in merged(_from_blocks(batches)):
            keys = e["key"].astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[48 * i : 48 * i + 48] for i in range(len(e))], pa.binary()), pa.array(e["row"]), pa.array(e["id"], mask=e["null"] > 0), pa.array(e["rows"])],
                ["key", "keep_row", "keep_id", "group_size"],
            )

    blocks = keyed.select("run", "key", "chars", "id", "row").mapInArrow(opening, _BLOCKS)
    for step in range(1, rounds + 1):
        met = blocks.repartition("dest").sortWithinPartitions("dest", "first")
        if step < rounds:
            blocks = met.mapInArrow(exchange(step), _BLOCKS)
    return met.mapInArrow(closing, "key binary, keep_row long, keep_id long, group_size long")


def _eight_bytes(n) -> F.Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", carried: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256, and the carried columns.

    Of equal texts the row with most code points stays, then that of the smallest id.
    """
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    plain = F.translate(whole, " \t\n\x0b\x0c\r", "")
    carried = carried or []
    keyed = docs.select(
        docs[id].cast("long").alias("id"), F.char_length(whole).cast("long").alias("chars"), plain.alias("plain"),
        F.struct(*[docs[c] for c in carried] or [F.lit(0).alias("none")]).alias("carried"),
    )
    key = F.concat(F.unhex(F.sha2(F.col("plain").cast("binary"), 256)), _eight_bytes(F.octet_length("plain")), _eight_bytes(F.xxhash64("plain")))
    keyed = keyed.select("id", "chars", key.alias("key"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"), "carried")
    keyed = stage(keyed.sortWithinPartitions("key", F.desc("chars"), "id"), "digests")
    runs = (keyed.agg(F.max("run")).head()[0] or 0) + 1
    best = winners(keyed, runs)
    # each run's distinct keys meet the winners, so a key of very many rows is one row a run there; then each run's rows meet these
    told = keyed.select("run", "key").distinct().join(best, "key")
    out = keyed.join(told, ["run", "key"])
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
        *(["carried"] if carried else []),
    )


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kept = groups(plain, names[docs.columns.index(text)], names[docs.columns.index(id)], names).where("kept")
    return kept.select(*[F.col(f"carried.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])
