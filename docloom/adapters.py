"""Model services as pluggable column functions, with deterministic defaults that need no network.

A service (embedding, recognition, generation, reranking) is any function from a pandas Series of texts to one of
results; ``apply`` runs it in Arrow batches. The defaults let every pipeline run and be tested as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Service = Callable[[pd.Series], pd.Series]


def hash_embedding(texts: pd.Series, dims: int = 64) -> pd.Series:
    """Signed hashes of words, scaled to length one; a null or empty text is the zero vector."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in (t or "").split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def no_recognition(texts: pd.Series) -> pd.Series:
    return texts.fillna("")


def extractive_answer(texts: pd.Series) -> pd.Series:
    """The first sentence of the context."""
    return texts.fillna("").str.split(".").str[0]


def apply(rows: DataFrame, column: str, into: str, service: Service, kind: str) -> DataFrame:
    """rows with the service's result for a column, in Arrow batches; the service is sent once to each task."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield service(batch)

    return rows.withColumn(into, run(F.col(column)))


def apply_or(rows: DataFrame, column: str, into: str, service: Service, kind: str, instead, group: int = 10) -> DataFrame:
    """As ``apply``, in groups of so many values; where the service fails, each value of the group is asked for alone, and
    one that fails again gets ``instead``. So a value that can't be served costs no other one its result."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def alone(value: pd.Series) -> list:
            try:
                return list(service(value))
            except Exception:  # of any service: what it raises isn't known here
                return [instead]

        for batch in batches:
            out: list = []
            for at in range(0, len(batch), group):
                some = batch.iloc[at : at + group]
                try:
                    out += list(service(some))
                except Exception:
                    for i in range(len(some)):
                        out += alone(some.iloc[i : i + 1])
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, run(F.col(column)))


HANDLERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_handler(kind: str, handler: Callable[[DataFrame], DataFrame]) -> None:
    """Tasks of a kind go to handler, which maps the rows (task_id, kind, payload) to (task_id, result)."""
    HANDLERS[kind] = handler


def run_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id, result, error) of tasks (task_id, kind, payload), each kind by its handler; a kind without one is an error."""
    shape = lambda df, result, error: df.select("task_id", result.cast("string").alias("result"), error.cast("string").alias("error"))
    out = shape(tasks.where(~F.coalesce(F.col("kind").isin(*HANDLERS), F.lit(False))), F.lit(None), F.concat(F.lit("no handler for "), F.coalesce("kind", F.lit("null"))))
    for kind, handler in sorted(HANDLERS.items()):
        out = out.unionByName(shape(handler(tasks.where(F.col("kind") == kind)), F.col("result"), F.lit(None)))
    return out
