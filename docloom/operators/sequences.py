"""Window-shaped computations over logs: islands, rates, breakers, versions, order of tasks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import stage


def islands(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """rows with island: a number that grows each time the value changes along a key's order."""
    by = Window.partitionBy(key).orderBy(*order)
    v = rows.withColumn("__v", value)
    v = v.withColumn("__new", F.coalesce((F.col("__v") != F.lag("__v").over(by)).cast("int"), F.lit(1)))
    return v.withColumn("island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__v", "__new")


def in_window(rows: DataFrame, key: str, at_micros: Column, micros: int) -> DataFrame:
    """rows with n: events of the key in the open-closed time before each, itself included."""
    by = Window.partitionBy(key).orderBy("__at").rangeBetween(-(micros - 1), 0)
    return rows.withColumn("__at", at_micros).withColumn("n", F.count("*").over(by)).drop("__at")


def version_chain(rows: DataFrame, key: str, order: list[str], content_hash: str) -> DataFrame:
    """rows with version (from 1) and previous_hash along a key's order."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(by)).withColumn("previous_hash", F.lag(content_hash).over(by))


def task_levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, level): the longest chain of dependencies below each task; tasks of a cycle stay out.

    A pass for each level, until one adds nothing: tasks all of whose dependencies have a level get the next one. Every
    16 levels what is done is written as one table.
    """
    done = tasks.join(edges.select(F.col("task")), "task", "left_anti").select("task", F.lit(0).alias("level"))
    left = edges.select("task", "needs").distinct()
    for level in itertools.count(1):
        open_ = left.join(done.select(F.col("task").alias("needs")), "needs", "left_anti").select("task").distinct()
        ready = left.select("task").distinct().join(open_, "task", "left_anti").join(done.select("task"), "task", "left_anti")
        ready = stage(ready.select("task", F.lit(level).alias("level")), "level")
        if not ready.head(1):
            break
        done = done.unionByName(ready)
        if level % 16 == 0:
            done = stage(done, "levels")
    return done


def exact_percentile(rows: DataFrame, key: str, value: str, q: float, slack: float = 0.001) -> DataFrame:
    """(key, percentile): exact, interpolated between neighbours, without holding a key's values in one task.

    A sketch brackets the rank; values below the bracket are only counted, those inside by value.
    """
    v = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"))
    around = v.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("__v", [max(0.0, q - slack), min(1.0, q + slack)], 10_000).alias("near"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    low = F.when((F.col("n") < 2 / slack) | F.lit(q <= slack), F.col("least")).otherwise(F.col("near")[0])
    high = F.when((F.col("n") < 2 / slack) | F.lit(q >= 1 - slack), F.col("most")).otherwise(F.col("near")[1])
    around = around.select(key, "n", low.alias("low"), high.alias("high"))
    placed = v.join(around, key).where(F.col("__v") <= F.col("high"))
    grouped = placed.groupBy(key, "n", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("__v")).agg(F.count("*").alias("times"))
    upto = grouped.withColumn("last", F.sum("times").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("__v"))))
    at = (F.col("n") - 1) * q
    pick = lambda place: F.min(F.when((F.col("last") > place) & F.col("__v").isNotNull(), F.col("__v")))
    ends = upto.groupBy(key, "n").agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("b"))
    return ends.select(key, (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("percentile"))
