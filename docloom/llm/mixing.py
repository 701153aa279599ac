"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are summed in cells (each combination of the dimensions, such as source, language and topic). The cells' weights
are raked: in turn, for each dimension, all weights of a value are scaled so that the value's weighted tokens reach its
target. A document's probability is its cell's weight times the factor at which the expected tokens are the budget,
1 at most; documents whose hashed id falls below it are taken.

Cells are far fewer than documents. Up to ``driver_cells`` of them (counted, never assumed) are raked in numpy on the
driver; more, whatever their values, are raked and calibrated by the same rules as Spark jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._split import free_name
from docloom.storage import stage, unstage

NONE = "(none)"


def place(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 13 hexadecimal digits of an md5 hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def smoothed_targets(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to tokens ** power: 1 keeps them as they are, 0 makes them equal."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else {}


def rake(tokens: np.ndarray, values: list[np.ndarray], targets: list[np.ndarray], rounds: int) -> np.ndarray:
    """Cell weights after ``rounds`` passes. values: each dimension's value number of each cell; targets: its shares."""
    weight = np.ones(len(tokens))
    total = tokens.sum()
    for _ in range(rounds):
        for value, target in zip(values, targets, strict=True):
            held = np.bincount(value, tokens * weight, minlength=len(target))
            weight *= np.where(held > 0, target * total / np.where(held > 0, held, 1), 0)[value]
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The factor at which the sum of tokens * min(1, factor * weight) is the budget, or all that weights allow."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    t, w = t[w > 0], w[w > 0]
    if not len(t):
        return 0.0
    sure = np.concatenate([[0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    factor = (budget - sure) / rest
    fits = np.flatnonzero(factor * w <= 1)
    return float(max(0.0, factor[fits[0]])) if len(fits) else float(1 / w[-1])


def _targets(cells: DataFrame, d: str, given: dict[str, float], power: float) -> DataFrame:
    """(dimension's value, target): the given shares of values that hold tokens, scaled to sum to 1, or smoothed ones."""
    spark = cells.sparkSession
    held = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given:
        aims = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, p double")
        found = held.join(F.broadcast(aims) if len(aims.head(10_001)) <= 10_000 else aims, d)
        if found.head(1):
            return stage(found.select(d, (F.col("p") / F.lit(found.agg(F.sum("p")).first()[0])).alias("target")), "targets")
    raised = held.select(d, F.pow("t", F.lit(power)).alias("p"))
    total = raised.agg(F.sum("p")).first()[0] or 1.0
    return stage(raised.select(d, (F.col("p") / total).alias("target")), "targets")


def _rake_cells(cells: DataFrame, dims: list[str], given: dict[str, dict[str, float]], power: dict[str, float], rounds: int) -> DataFrame:
    """The same passes as a Spark job, for any number of cells and values; each is two joins on a dimension's value."""
    total = cells.agg(F.sum("tokens")).first()[0]
    targets = {d: _targets(cells, d, given.get(d, {}), power.get(d, 0.5)) for d in dims}
    cells, before = cells.withColumn("weight", F.lit(1.0)), None
    for r in range(rounds):
        for d in dims:
            held = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("held"))
            scale = held.join(targets[d], d, "left").select(d, F.when(F.col("held") > 0, F.coalesce("target", F.lit(0.0)) * total / F.col("held")).otherwise(0.0).alias("scale"))
            cells = cells.join(scale, d).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        cells = stage(cells, f"rake{r}")
        if before is not None:
            unstage(before)
        before = cells
    return cells


def _calibrate_cells(raked: DataFrame, budget: float) -> float:
    """calibrate as Spark sums: cells that the factor makes sure give their tokens, until no further cell is sure."""
    least, n, factor = raked.where("weight > 0").agg(F.min("weight"), F.count("*")).first() + (0.0,)
    sure = 0
    while n:
        is_sure = F.col("weight") * factor > 1
        tokens, rest, held = raked.where("weight > 0").agg(
            F.coalesce(F.sum(F.when(is_sure, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_sure, F.col("tokens") * F.col("weight"))), F.lit(0.0)), F.sum(is_sure.cast("long"))
        ).first()
        if held == n or rest <= 0:
            return 1 / least
        if factor and held == sure:
            return factor
        sure, factor = held, max(0.0, (budget - tokens) / rest)
        if not factor:
            break
    return 0.0


def _cells(docs: DataFrame, dims: list[str], tokens: Column) -> DataFrame:
    sized = docs.select(tokens.cast("long").alias("n_tokens"), *[F.coalesce(docs[d].cast("string"), F.lit(NONE)).alias(d) for d in dims])
    return sized.groupBy(*dims).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def weigh(cells: DataFrame, dims: list[str], power: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, share: float = 0.5, rounds: int = 30, driver_cells: int = 200_000) -> DataFrame:
    """(dims, weight, prob) of each cell: raked weights and calibrated probabilities.

    Up to ``driver_cells`` cells (counted) come back as a table that is broadcast to its joins; more stay a plain table.
    """
    power, given = power or {}, {d: {k: v for k, v in t.items() if v > 0} for d, t in (targets or {}).items()}
    spark, shape = cells.sparkSession, ", ".join(f"{d} string" for d in dims)
    if cells.count() <= driver_cells:
        rows = sorted(cells.collect())
        count = np.array([r["tokens"] for r in rows])
        names = [sorted({r[d] for r in rows}) for d in dims]
        number = [{k: i for i, k in enumerate(n)} for n in names]
        values = [np.array([number[k][r[d]] for r in rows], np.int64) for k, d in enumerate(dims)]
        aims = []
        for k, d in enumerate(dims):
            sums = dict(zip(names[k], np.bincount(values[k], count, len(names[k])).tolist(), strict=True))
            mine = {v: g for v, g in given.get(d, {}).items() if sums.get(v)}
            aim = {v: g / sum(mine.values()) for v, g in mine.items()} if mine else smoothed_targets(sums, power.get(d, 0.5))
            aims.append(np.array([aim.get(v, 0.0) for v in names[k]]))
        weight = rake(count, values, aims, rounds)
        factor = calibrate(count, weight, share * count.sum())
        return F.broadcast(spark.createDataFrame([(*[r[d] for d in dims], float(w), float(min(1.0, w * factor))) for r, w in zip(rows, weight, strict=True)], f"{shape}, weight double, prob double"))
    raked = _rake_cells(cells, dims, given, power, rounds)
    factor = _calibrate_cells(raked, share * (cells.agg(F.sum("tokens")).first()[0] or 0.0))
    return raked.select(*dims, "weight", F.least(F.lit(1.0), F.col("weight") * factor).alias("prob"))


def mix(docs: DataFrame, dims: list[str], tokens: Column, seed: int = 7, **how) -> DataFrame:
    """One row per document: doc_id, the dimensions as text, n_tokens, weight, prob and sampled.

    dims name columns of docs; a null is the value "(none)". how: as weigh takes it. targets[d] gives shares of a
    dimension's values, which are scaled to sum to 1 over the values that hold tokens; a value without one gets no tokens,
    and its documents aren't sampled. A dimension without targets takes its tokens ** power[d] (0.5). The budget is
    ``share`` of all tokens. Documents without tokens are sampled by their cell's probability too. Rows of equal doc_id
    are taken or left together within a cell; a null doc_id is one id. An empty table gives no rows.
    """
    # Written once: both the cells and the rows below read it.
    sized = stage(docs.select(F.col("doc_id").alias("doc_id"), tokens.cast("long").alias("n_tokens"), *[F.coalesce(docs[d].cast("string"), F.lit(NONE)).alias(d) for d in dims]), "sized")
    cells = stage(_cells(sized, dims, F.col("n_tokens")), "cells")
    joined = sized.join(weigh(cells, dims, **how), dims)
    return joined.select("doc_id", *dims, "n_tokens", "weight", "prob", (place(F.col("doc_id"), seed) < F.col("prob")).alias("sampled"))


def sample(docs: DataFrame, dims: dict[str, Column], tokens: Column, seed: int = 7, **how) -> DataFrame:
    """The rows of docs, all columns, that ``mix`` samples: each row is judged in place by its cell's probability.

    dims gives each dimension as an expression over docs. With at most driver_cells cells nothing but the cells' sums is
    shuffled.
    """
    names = {d: free_name(docs.columns, f"__dim{i}") for i, d in enumerate(dims)}
    cells = stage(_cells(docs.select(tokens.alias("__tokens"), *[dims[d].alias(n) for d, n in names.items()]), list(names.values()), F.col("__tokens")), "cells")
    renamed = {k: {names[d]: v for d, v in how.pop(k).items()} for k in ("power", "targets") if how.get(k)}
    prob = free_name(docs.columns, "__prob")
    weights = weigh(cells, list(names.values()), **renamed, **how).select(*names.values(), F.col("prob").alias(prob))
    joined = docs.withColumns({n: F.coalesce(dims[d].cast("string"), F.lit(NONE)) for d, n in names.items()}).join(weights, list(names.values()))
    return joined.where(place(docs["doc_id"], seed) < F.col(prob)).select(*[docs[c] for c in docs.columns])
