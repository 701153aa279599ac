"""Conditional fetching, settled files, polling and watchdogs, as joins and windows over what was seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.latest import upsert

STATE = ["url", "etag", "last_modified", "size", "page_hash"]


def decide(state: DataFrame, heads: DataFrame) -> DataFrame:
    """heads (url, etag, last_modified, size) with action: "skip" if the server says nothing changed, else "fetch".

    Nothing changed if both ETags are there and equal; where one lacks, if both times are there and equal and the sizes don't
    differ. A url that wasn't seen before is fetched.
    """
    old = state.select("url", F.col("etag").alias("o_etag"), F.col("last_modified").alias("o_modified"), F.col("size").alias("o_size"), F.col("page_hash").alias("o_hash"))
    same_tag = F.col("etag") == F.col("o_etag")
    same_time = (F.col("last_modified") == F.col("o_modified")) & F.coalesce(F.col("size") == F.col("o_size"), F.lit(True))
    same = F.coalesce(same_tag, same_time, F.lit(False))
    return heads.join(old, "url", "left").withColumn("action", F.when(same, "skip").otherwise("fetch"))


def fetched(decisions: DataFrame, bodies: DataFrame) -> DataFrame:
    """(url, etag, last_modified, size, page_hash, action) after a fetch: "skip", or "same" or "changed" by the page's hash.

    bodies (url, body) are read for urls that are to be fetched only. A url whose body lacks keeps its hash and is "failed".
    """
    wanted = decisions.where("action = 'fetch'").select("url")
    got = bodies.join(wanted, "url", "left_semi").select("url", F.sha2(F.col("body").cast("binary"), 256).alias("new_hash"))
    seen = decisions.join(got, "url", "left")
    action = F.when(F.col("action") == "skip", "skip").when(F.col("new_hash").isNull(), "failed").when(F.col("new_hash").eqNullSafe(F.col("o_hash")), "same").otherwise("changed")
    return seen.select("url", "etag", "last_modified", "size", F.coalesce("new_hash", "o_hash").alias("page_hash"), action.alias("action"))


def remember(state: DataFrame, results: DataFrame) -> DataFrame:
    """The state after a run: what was fetched takes the place of what was known; failed fetches change nothing."""
    new = results.where("action <> 'failed'").select(*STATE).withColumn("__run", F.lit(1))
    return upsert(state.select(*STATE).withColumn("__run", F.lit(0)), new, ["url"], [F.desc("__run")]).select(*STATE)


def settled(listings: DataFrame, quiet_seconds: int = 5) -> DataFrame:
    """(path, size, listed_at): when a file is safe to read: the first listing that finds it as the one before did, at least
    the quiet time after its last change; again after each further change. Empty files are left out.

    listings: path, size, modified, listed_at; a path's listings in order of time.
    """
    by = Window.partitionBy("path").orderBy("listed_at")
    state = F.struct("size", "modified")
    fresh = ~F.coalesce(F.lag(state).over(by).eqNullSafe(state) & F.lag("listed_at").over(by).isNotNull(), F.lit(False))
    rows = listings.withColumn("fresh", fresh).withColumn("since", F.last(F.when(F.col("fresh"), F.col("listed_at")), ignorenulls=True).over(by))
    calm = rows.where(~F.col("fresh") & (F.col("size") > 0) & (F.unix_micros(F.col("listed_at").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= quiet_seconds * 1_000_000))
    return calm.groupBy("path", "since").agg(F.min_by("size", "listed_at").alias("size"), F.min("listed_at").alias("listed_at")).select("path", "size", "listed_at")


def polls(ticks: DataFrame, sources: DataFrame, every: Column) -> DataFrame:
    """(source, tick): the ticks at which each source is polled: the first, and those that begin a further interval of its own.

    ticks: tick (long), of a beat that numbers them from 0; sources: source and what ``every`` reads, the interval in beats
    (one at least). Beats decide, so no poll waits for the one before to be written.
    """
    rate = sources.select("source", F.greatest(F.lit(1), F.ceil(every)).cast("long").alias("every"))
    last = ticks.agg(F.max("tick").alias("last"))
    due = rate.join(F.broadcast(last)).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.col("every"))).alias("tick"))  # last: one row
    return due.join(ticks.select("tick").distinct(), "tick", "left_semi").select("source", "tick")


def watchdog(checks: DataFrame, limit: int = 5, done_share: float = 0.9) -> DataFrame:
    """(job, check, action) of checks (job, check, entities, documents, total): "restart" at each ``limit``-th check in a row
    that finds as many entities as the one before it did, "done" at the first that finds the share of documents; checks
    after that aren't acted on.
    """
    by = Window.partitionBy("job").orderBy("check")
    ready = F.col("documents") >= F.col("total") * done_share
    rows = checks.withColumn("ready", F.coalesce(ready, F.lit(False))).withColumn("ended", F.coalesce(F.max(F.col("ready").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where("ended = 0").withColumn("moved", F.coalesce((~F.lag("entities").over(by).eqNullSafe(F.col("entities"))).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("moved").over(by))
    rows = rows.withColumn("equal", F.row_number().over(Window.partitionBy("job", "island").orderBy("check")) - 1)
    action = F.when(F.col("ready"), "done").when((F.col("equal") > 0) & (F.col("equal") % limit == 0), "restart")
    return rows.select("job", "check", action.alias("action")).where("action IS NOT NULL")
