"""Circuit breakers with a half-open period, over logs of any size.

A backend's breaker opens after some failures in a row. While it is open its calls are refused; the first call after the wait
is a trial: success closes the breaker, failure opens it for another wait.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

State = tuple[int, int | None]  # failures in a row; since when it is open, in microseconds
CLOSED: State = (0, None)


def step(state: State, at: int, ok: bool, limit: int, wait: int) -> tuple[State, str | None]:
    """The state after a call, and what changed: opened, reopened, closed, refused or nothing."""
    failures, since = state
    if since is not None:
        if at - since < wait:
            return state, "refused"
        return (CLOSED, "closed") if ok else ((failures, at), "reopened")
    if ok:
        return CLOSED, None
    return ((failures + 1, at), "opened") if failures + 1 >= limit else ((failures + 1, None), None)


def fold(state: State, calls: Iterable[tuple[int, int, bool]], limit: int, wait: int) -> tuple[State, list[tuple[int, str]]]:
    """The state after calls (id, microseconds, ok) in order, and (id, change) of those that changed something."""
    changes = []
    for call, at, ok in calls:
        state, change = step(state, at, ok, limit, wait)
        if change:
            changes.append((call, change))
    return state, changes


def last_before(rows: DataFrame, key: str, at: str, order: str, value: Column, name: str, bucket: int) -> DataFrame:
    """rows with ``name``: the last value that isn't null in the rows of the key before, by (at, order).

    Rows are dealt by key and stretch of time (``bucket``, in the unit of ``at``), and what a stretch inherits is found from a
    row for each stretch, so a key with most of the rows is many tasks.
    """
    r = rows.withColumn("__bucket", F.floor(F.col(at) / bucket)).withColumn("__value", value)
    latest = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(at, order)))
    ends = r.groupBy(key, "__bucket").agg(latest.alias("__end"))
    past = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "__bucket", F.last("__end", ignorenulls=True).over(past).alias("__carried"))
    here = Window.partitionBy(key, "__bucket").orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    own = r.withColumn("__own", F.last("__value", ignorenulls=True).over(here))
    return own.join(carried, [key, "__bucket"]).withColumn(name, F.coalesce("__own", "__carried")).drop("__bucket", "__value", "__own", "__carried")


def changes(calls: DataFrame, key: str, at: str, call: str, ok: str, limit: int = 3, wait_seconds: int = 30) -> DataFrame:
    """(key, call, change): what each call does to its backend's breaker, for calls that change it or are refused.

    The fold is sequential, but a success whose last failure lies at least the wait before it leaves the breaker closed,
    whatever was before: an opening needs a failure, and has ended by then. Logs are cut behind them, and only pieces with
    ``limit`` failures are folded, each in order. A piece is as long as a backend's trouble, not as its log. Rows need a
    key and a time; those without are left out.
    """
    wait = wait_seconds * 1_000_000
    rows = calls.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(call).alias("c"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    rows = last_before(rows, "k", "t", "c", F.when(~F.col("ok"), F.col("t")), "failed", max(wait, 3_600_000_000))
    clear = F.col("ok") & (F.col("failed").isNull() | (F.col("t") - F.col("failed") >= wait))
    rows = rows.withColumn("clear", clear).drop("failed")
    rows = last_before(rows, "k", "t", "c", F.when(F.col("clear"), F.struct("t", "c")), "piece", max(wait, 3_600_000_000))
    troubled = rows.groupBy("k", "piece").agg(F.count_if(~F.col("ok")).alias("failures")).where(F.col("failures") >= limit).select("k", F.coalesce(F.to_json("piece"), F.lit("")).alias("p"))
    rows = rows.select("k", F.coalesce(F.to_json("piece"), F.lit("")).alias("p"), "t", "c", "ok").join(troubled, ["k", "p"], "left_semi")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "c"])
        _, found = fold(CLOSED, zip(part["c"].tolist(), part["t"].tolist(), part["ok"].tolist(), strict=True), limit, wait)
        return pd.DataFrame({"k": [part["k"].iloc[0]] * len(found), "c": [c for c, _ in found], "change": [x for _, x in found]}, dtype=object)

    kinds = dict(rows.dtypes)
    out = rows.groupBy("k", "p").applyInPandas(run, f"k {kinds['k']}, c {kinds['c']}, change string")
    return out.select(F.col("k").alias(key), F.col("c").alias(call), "change")
