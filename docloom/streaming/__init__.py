"""Structured Streaming forms of the incremental operators; each has a batch query that it equals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import breaker as B
from docloom.sources.tableset import TableSet

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; ts becomes a timestamp with zone, as watermarks need one."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def watch_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream of (path, content, sha256); files should be renamed into it when complete."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "content", F.sha2("content", 256).alias("sha256"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late)
    return e.groupBy("event_type", F.window("ts", size)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late)
    return e.groupBy("event_type", F.window("ts", size, step)).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Debounced events: a session's last event stands for it."""
    e = events.withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")).select("user_id", "n", "last_event")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _in_order(batches: Iterator[pd.DataFrame], state: GroupState) -> pd.DataFrame:
    """A key's rows of one batch in order, without those that the watermark has passed."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    return rows[rows["ts"].astype("int64") // 1_000_000 >= state.getCurrentWatermarkMs()]


def _keep(state: GroupState, value: tuple, last_ms: int) -> None:
    """Keep the state until the watermark passes last_ms; then the key is forgotten."""
    state.update(value)
    state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs() + 1))


def admit(events: DataFrame, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, admitted): a client's events while fewer than ``most`` admitted ones lie in the last seconds.

    Rejected events don't count, so this is state and no window frame. State holds at most ``most`` times a client and
    goes when the watermark has passed the last of them by ``seconds``. A batch's events are judged in order; events
    behind the watermark are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows, out = _in_order(batches, state), []
        for event, at in zip(rows["event_id"], rows["ts"].astype("int64") // 1000, strict=True):
            times = [t for t in times if t > at - seconds * 1_000_000]
            ok = len(times) < most
            if ok:
                times.append(int(at))
            out.append((int(event), int(key[0]), ok))
        if times:
            _keep(state, (times,), max(times) // 1000 + seconds * 1000)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "admitted"])

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts").withWatermark("ts", late)
    return e.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def consecutive_failures(events: DataFrame, limit: int = 3, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """(user_id, event_id): the event at which a backend's breaker opens, after ``limit`` failures in a row.

    A backend that the watermark has passed by ``idle_seconds`` is forgotten. Order and late events: as in admit.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run = state.get[0] if state.exists else 0
        rows, out = _in_order(batches, state), []
        for r in rows.itertuples():
            run = run + 1 if r.event_type == "error" else 0
            if run == limit:
                out.append((int(key[0]), int(r.event_id)))
        if len(rows):
            _keep(state, (run,), int(rows["ts"].astype("int64").max()) // 1_000_000 + idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late)
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "run long", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(events: DataFrame, limit: int = 3, wait_seconds: int = 30, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """(user_id, event_id, change): breaker.changes as a stream: opened, refused, and how the trial after the wait ended.

    State is two numbers a backend; it goes when the watermark has passed the backend's last call by the wait and
    ``idle_seconds``, and a backend that comes back is closed. Order and late events: as in admit.
    """
    wait = wait_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, since = state.get if state.exists else (0, -1)
        rows = _in_order(batches, state)
        at = (rows["ts"].astype("int64") // 1000).tolist()
        calls = zip(rows["event_id"].tolist(), at, (rows["event_type"] != "error").tolist(), strict=True)
        (failures, since), found = B.fold((failures, None if since < 0 else since), calls, limit, wait)
        if at:
            _keep(state, (failures, -1 if since is None else since), max(at) // 1000 + (wait_seconds + idle_seconds) * 1000)
        yield pd.DataFrame({"user_id": [int(key[0])] * len(found), "event_id": [c for c, _ in found], "change": [x for _, x in found]}, dtype=object)

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late)
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, change string", "failures long, since long", "append", GroupStateTimeout.EventTimeTimeout)


def list_folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, modified, listed_at) of a folder's files now; contents aren't read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.current_timestamp().alias("listed_at"))


LISTING = "path string, size long, modified timestamp, listed_at timestamp"


def settled(listings: DataFrame, quiet_seconds: int = 5, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """(path, size, listed_at): fetching.settled as a stream of listings: a file is out once it has been quiet and two
    listings in a row agree on its size and time. A path that no listing names for ``idle_seconds`` is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, modified, since, out_ = state.get if state.exists else (-1, -1, -1, True)
        rows = pd.concat(list(batches)).sort_values("listed_at")
        out, now = [], -1
        for n, m, at, stamp in zip(rows["size"], rows["modified"].astype("int64") // 1000, rows["listed_at"].astype("int64") // 1000, rows["listed_at"], strict=True):
            now = int(at)
            if since < 0 or (int(n), int(m)) != (size, modified):
                size, modified, since, out_ = int(n), int(m), now, False
            elif not out_ and size > 0 and now - since >= quiet_seconds * 1_000_000:
                out_ = True
                out.append((key[0], size, stamp))
        if now >= 0:
            _keep(state, (size, modified, since, out_), now // 1000 + idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["path", "size", "listed_at"], dtype=object)

    e = listings.withColumn("listed_at", F.col("listed_at").cast("timestamp")).withColumn("modified", F.col("modified").cast("timestamp")).withWatermark("listed_at", late)
    return e.groupBy("path").applyInPandasWithState(step, "path string, size long, listed_at timestamp", "size long, modified long, since long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def watchdog(checks: DataFrame, limit: int = 5, done_share: float = 0.9, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """(job, check, action): fetching.watchdog as a stream; checks have a time ``ts`` besides."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entities, equal, ended = state.get if state.exists else (-1, 0, False)
        rows, out = pd.concat(list(batches)).sort_values("check"), []
        for r in rows.itertuples():
            if ended:
                break
            equal = equal + 1 if r.entities == entities else 0
            entities = int(r.entities)
            ended = r.documents >= r.total * done_share
            if ended:
                out.append((int(key[0]), int(r.check), "done"))
            elif equal and equal % limit == 0:
                out.append((int(key[0]), int(r.check), "restart"))
        if len(rows):
            _keep(state, (entities, equal, bool(ended)), int(rows["ts"].astype("int64").max()) // 1_000_000 + idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["job", "check", "action"], dtype=object)

    e = checks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("job").applyInPandasWithState(step, "job long, check long, action string", "entities long, equal long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_cache(requests: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, hit): whether a request finds an answer that a miss of its key put in the cache less than
    ``seconds`` before; a miss puts a new one. The state of a key goes with its answer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        filled = state.get[0] if state.exists else None
        rows, out = _in_order(batches, state), []
        for event, at in zip(rows["event_id"], rows["ts"].astype("int64") // 1000, strict=True):
            hit = filled is not None and at < filled + seconds * 1_000_000
            filled = filled if hit else int(at)
            out.append((int(event), int(key[0]), hit))
        if filled is not None:
            _keep(state, (filled,), filled // 1000 + seconds * 1000)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "hit"])

    e = requests.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts").withWatermark("ts", late)
    return e.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, hit boolean", "filled long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(files: DataFrame, checkpoint: str, callbacks: list[Callable[[DataFrame, int], None]]) -> None:
    """Give each batch of new files to the callbacks in turn, as (files, batch number). A batch whose callback fails comes
    again as a whole, so callbacks should write by key."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for callback in callbacks:
                callback(batch, number)
        finally:
            batch.unpersist()

    run_available(files, checkpoint, each)


def ingest_into(files: DataFrame, checkpoint: str, tables: TableSet, pipeline: Callable[[DataFrame], dict[str, tuple[DataFrame, list[str]]]]) -> None:
    """Take each batch of new files into a set of tables, all of them or none, once.

    pipeline makes of the batch's files the new rows of some tables and the keys that identify a row. A batch whose commit
    failed comes again; one that was committed just before a failure comes again too, and then changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        made = pipeline(batch)
        change = lambda rows, keys: lambda old: (rows if old is None else rows.unionByName(old.join(rows.select(*keys).distinct(), keys, "left_anti"))).dropDuplicates(keys)
        tables.commit({name: change(rows, keys) for name, (rows, keys) in made.items()}, f"{checkpoint}#{number}")

    run_available(files, checkpoint, each)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there and stop: the form of a scheduled poll."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
