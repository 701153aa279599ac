"""Held-out rows, bounded samples and columns appended to rows: what the trained operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.latest import look_up
from docloom.storage import stage


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, mod modulus; a null doc_id counts as 1, so its row is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(1))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, key: list[str]) -> DataFrame:
    """Rows of about per_stratum distinct keys of each value of ``stratum``, chosen by a hash; all where there are fewer.

    The share of keys is set from an estimate of their number (a sketch of fixed size, 2 % off at most as a rule), so no
    value of stratum is lost, and a key that many rows repeat counts as one. The choice depends on the rows alone, so a
    task that runs again chooses the same ones. Repeats of a chosen key all come back: drop them before collecting. The
    shares are a table that is joined, so stratum may have any number of values; rows without one are left out.
    """
    place = F.xxhash64(*key, F.lit(17))
    counts = rows.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.approx_count_distinct(place, 0.02).alias("n"))
    whole = F.col("n") <= int(1.1 * per_stratum)
    shares = stage(counts.select(stratum, F.when(whole, 1.0).otherwise(F.lit(float(per_stratum)) / F.col("n")).alias("__share")), "shares")
    chosen = look_up(rows, shares, [stratum], key[0])
    return chosen.where(F.pmod(place, F.lit(1 << 30)) / float(1 << 30) < F.col("__share")).select(*rows.columns)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores before it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def append_columns(docs: DataFrame, text: str, compute: Callable[[pa.Array], dict[str, list]], added: T.StructType) -> DataFrame:
    """docs with the columns ``added``, which compute makes from each Arrow batch's texts.

    Rows and their other columns pass through unchanged. The new columns take the place of columns of the same name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in added} or c == text]
    if text.lower() in {f.name.lower() for f in added}:
        raise ValueError(f"{text} can't be both read and added")
    source = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*source.schema.fields, *added.fields])
    at, arrow = kept.index(text), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch.column(at))
            columns = [*batch.columns, *(pa.array(new[f.name], type=f.type) for f in arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *arrow.names])

    return source.mapInArrow(run, schema)
