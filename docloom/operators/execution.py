"""Plans of tasks and settings, as logs: tries and dependencies, edits and switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.latest import last_n
from docloom.storage import stage


def states(tasks: DataFrame, edges: DataFrame, attempts: DataFrame, tries: int = 3) -> DataFrame:
    """(task, status): done if one of the first ``tries`` attempts succeeded, failed if so many failed, blocked if it isn't
    either and depends on a failed task through any number of others, else pending.

    edges: task, needs; attempts: task, attempt (from 1), ok. Blocking spreads in rounds, each from what the one before
    blocked, so circles end.
    """
    own = attempts.where(F.col("attempt") <= tries).groupBy("task").agg(F.bool_or("ok").alias("ok"), F.count("*").alias("n"))
    status = F.when(F.col("ok"), "done").when(F.col("n") >= tries, "failed").otherwise("pending")
    own = stage(tasks.select("task").distinct().join(own, "task", "left").select("task", status.alias("status")), "states")
    fresh = own.where("status = 'failed'").select("task")
    hit = None
    while fresh.head(1):
        further = edges.join(fresh.select(F.col("task").alias("needs")), "needs", "left_semi").select("task").distinct()
        fresh = stage(further if hit is None else further.join(hit, "task", "left_anti"), "blocked")
        hit = fresh if hit is None else hit.unionByName(fresh)
    if hit is None:
        return own
    marked = own.join(hit.withColumn("hit", F.lit(True)), "task", "left")
    return marked.select("task", F.when((F.col("status") == "pending") & F.col("hit"), "blocked").otherwise(F.col("status")).alias("status"))


def settings_in_force(edits: DataFrame, switches: DataFrame) -> DataFrame:
    """The latest edit of each key (preset, kind, value, at) of the preset that the latest switch (preset, at) names."""
    active = switches.orderBy(F.desc("at")).limit(1).select("preset")
    mine = edits.join(F.broadcast(active), "preset", "left_semi")  # one row
    return last_n(mine, ["preset", "kind"], [F.desc("at")], 1)
