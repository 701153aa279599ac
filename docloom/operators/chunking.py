"""Table-valued text chunking: fixed windows and recursive separators, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(" ")
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
FIXED = "doc_id long, chunk_index int, start_pos int, end_pos int, content string"
RECURSIVE = "doc_id long, chunk_index int, content string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Characters of chunks that a task holds before it gives them back.
_HELD = 4_000_000


def fixed_windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, stripped text) of windows; one ends behind the last space of its second half, if that has any.

    The last windows' ends may lie past the text; a window that only repeats the end of the one before is one too. The
    places behind spaces are found once; each window looks up the last of them that is in its reach.
    """
    behind = [m.end() for m in _BLANK.finditer(text)]
    begin = 0
    while begin < len(text):
        reach = begin + size
        last = bisect_right(behind, reach) - 1
        if reach < len(text) and last >= 0 and behind[last] > begin + size // 2:
            reach = behind[last]
        if shown := text[begin:reach].strip():
            yield begin, reach, shown
        begin = reach - overlap


def _pieces(text: str, separators: list[str]) -> tuple[list[str], list[str]]:
    """Pieces parted at the first separator that occurs, which begins the piece behind it; and the separators left."""
    for i, s in enumerate(separators):
        if s == "":
            return list(text), []
        if s in text:
            first, *rest = text.split(s)
            return [p for p in (first, *(s + r for r in rest)) if p], separators[i + 1 :]
    return [text], []


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces in chunks of at most size; a chunk begins with the pieces that end the one before."""
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if chunk := "".join(held).strip():
                yield chunk
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if chunk := "".join(held).strip():
        yield chunk


def recursive_chunks(text: str, size: int, overlap: int, separators: list[str] | None = None) -> Iterator[str]:
    """Chunks of at most size characters, parted at the coarsest separators that serve."""
    pieces, finer = _pieces(text, SEPARATORS if separators is None else separators)
    small: list[str] = []
    for p in pieces:
        if len(p) <= size:
            small.append(p)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if finer:
            yield from recursive_chunks(p, size, overlap, finer)
        elif p.strip():
            yield p.strip()
    yield from _pack(small, size, overlap)


def _run(kind: str, size: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each batch's texts, given back whenever so many characters are held; one text at a time is a Python string."""
    names, find = (FIXED, fixed_windows) if kind == "fixed" else (RECURSIVE, recursive_chunks)
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in names.split(", "))])
    rows, held = [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc = doc.as_py()
            for i, c in enumerate(find(text.as_py() or "", size, overlap)):
                rows.append((doc, i, *c) if kind == "fixed" else (doc, i, c))
                held += len(rows[-1][-1])
                if held > _HELD:
                    yield packed()
                    rows, held = [], 0
    if rows:
        yield packed()


def chunk(docs: DataFrame, kind: str = "recursive", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of each document (doc_id, text); overlap must be under half of size, or windows might not advance."""
    if not 0 <= 2 * overlap < size:
        raise ValueError("overlap must be at least 0 and under half of size")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_run, kind, size, overlap), FIXED if kind == "fixed" else RECURSIVE)


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_seq from 1, total_chunks and an id that names the document too."""
    totals = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    seq = F.col("chunk_index") + 1
    return chunks.join(totals, "doc_id").withColumn("chunk_seq", seq).withColumn("chunk_id", F.format_string("%d_chunk_%05d", F.col("doc_id"), seq))
