"""Windows, sorts, set operations, incremental state and streams as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import breaker, experiments, fetching, latest, sequences
from docloom.plans._catalog import VIEW_SQL, query
from docloom.plans.aggregates import v_metric
from docloom.plans.views import v_document, v_log, v_page, v_qa
from docloom.sources.web import page_changes as changes_of
from docloom.storage import read_table

VIEW_SQL["v_task"] = "SELECT o_orderkey AS task, o_orderkey // 5 AS plan, o_orderkey % 5 AS step, o_orderpriority AS priority FROM orders"


@query("SELECT event_id, user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM v_log) WHERE place <= 50")
def last_n_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 entries of each log."""
    return latest.last_n(v_log(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "kind")


@query("SELECT metric, string_agg(CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY record) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY record DESC) AS place FROM v_metric) WHERE place <= 100 GROUP BY metric")
def metric_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's last values in order of time."""
    last = latest.last_n(v_metric(spark, sf_dir), ["metric"], [F.desc("record")], 100)
    seq = F.array_sort(F.collect_list(F.struct("record", F.round(F.col("score") * 1000).cast("long").cast("string").alias("s"))))
    return last.groupBy("metric").agg(F.array_join(F.transform(seq, lambda x: x["s"]), ",").alias("trend"))


@query("""SELECT user_id, bucket, CASE WHEN bucket <= 50.0 THEN 'control' WHEN bucket <= 80.0 THEN 'a' ELSE 'b' END AS variant FROM (SELECT user_id,
(36 * CAST('0x' || substr(h, 1, 8) AS BIGINT) + 16 * CAST('0x' || substr(h, 9, 8) AS BIGINT) + 96 * CAST('0x' || substr(h, 17, 8) AS BIGINT) + CAST('0x' || substr(h, 25, 8) AS BIGINT)) % 100 AS bucket
FROM (SELECT c_custkey AS user_id, md5('exp1-' || c_custkey) AS h FROM customer))""")
def ab_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' variants by hash bucket and cumulative share."""
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return experiments.assign(users, "exp1", [("control", 5), ("a", 3), ("b", 2)])


@query("SELECT event_id, n < 10 AS admitted, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM v_log)")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a client within the hour before each, against the limit."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return sequences.in_window(v_log(spark, sf_dir), "user_id", at, 3_600_000_000).select("event_id", (F.col("n") < 10).alias("admitted"), "n")


_ISLAND = """SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ok IS NOT DISTINCT FROM lag(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM v_log)"""


@query(f"SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS checks, min(event_id) AS first_event FROM ({_ISLAND}) GROUP BY user_id, island HAVING count(*) >= 5")
def stall_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least five checks without a change."""
    i = sequences.islands(v_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("ok"))
    return i.groupBy("user_id", "island").agg(F.count("*").alias("checks"), F.min("event_id").alias("first_event")).where("checks >= 5")


@query(f"SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS failures FROM ({_ISLAND}) WHERE NOT ok GROUP BY user_id, island HAVING count(*) >= 3")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures in a row open a backend's breaker; a success closes it."""
    i = sequences.islands(v_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("ok")).where(~F.col("ok"))
    return i.groupBy("user_id", "island").agg(F.count("*").alias("failures")).where("failures >= 3")


_WAIT = 12 * 3600


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT user_id, event_id, ok, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM v_log WHERE user_id IS NOT NULL),
walk(user_id, event_id, place, failures, since, change) AS (SELECT user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT user_id FROM c) UNION ALL
  SELECT w.user_id, c.event_id, c.place, CASE WHEN since IS NOT NULL AND t - since < {_WAIT}000000 THEN failures WHEN c.ok THEN 0 WHEN since IS NOT NULL THEN failures ELSE failures + 1 END,
    CASE WHEN since IS NOT NULL AND t - since < {_WAIT}000000 THEN since WHEN c.ok THEN NULL WHEN since IS NOT NULL OR failures + 1 >= 3 THEN t END,
    CASE WHEN since IS NOT NULL AND t - since < {_WAIT}000000 THEN 'refused' WHEN since IS NOT NULL THEN CASE WHEN c.ok THEN 'closed' ELSE 'reopened' END WHEN NOT c.ok AND failures + 1 >= 3 THEN 'opened' END
  FROM walk w JOIN c ON c.user_id = w.user_id AND c.place = w.place + 1)
SELECT user_id, event_id, change FROM walk WHERE change IS NOT NULL""")
def breaker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakers with a half-open period (of half a day here, as calls are hours apart): what each call changes."""
    return breaker.changes(v_log(spark, sf_dir), "user_id", "ts", "event_id", "ok", 3, _WAIT)


@query("""SELECT kind, count(*) AS n, max_by(event_id, (ts, event_id)) AS last_event FROM (SELECT *, sum(fresh) OVER (PARTITION BY kind ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY kind ORDER BY ts, event_id)) < 300000000 THEN 0 ELSE 1 END AS fresh FROM v_log)) GROUP BY kind, s""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A burst of changes stands as its last one, once it has been quiet (for five minutes here)."""
    last = F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")
    return v_log(spark, sf_dir).groupBy("kind", F.session_window("ts", "5 minutes")).agg(F.count("*").alias("n"), last).select("kind", "n", "last_event")


_LISTED = "SELECT user_id AS path, length(kind) - 4 AS size, CAST(NULL AS BIGINT) AS modified, ts AS listed_at FROM v_log"


@query(f"""WITH l AS (SELECT *, coalesce(size <> lag(size) OVER w, TRUE) AS fresh FROM ({_LISTED}) WINDOW w AS (PARTITION BY path ORDER BY listed_at)),
s AS (SELECT *, last_value(CASE WHEN fresh THEN listed_at END IGNORE NULLS) OVER (PARTITION BY path ORDER BY listed_at) AS since FROM l)
SELECT path, CAST(arg_min(size, listed_at) AS INTEGER) AS size, min(listed_at) AS listed_at FROM s WHERE NOT fresh AND size > 0 AND epoch_us(listed_at) - epoch_us(since) >= 3600000000 GROUP BY path, since""")
def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that two listings find alike, and quiet (for an hour here) since their last change."""
    listed = v_log(spark, sf_dir).select(F.col("user_id").alias("path"), (F.length("kind") - 4).alias("size"), F.lit(None).cast("long").alias("modified"), F.col("ts").alias("listed_at"))
    return fetching.settled(listed, 3600)


VIEW_SQL["v_head"] = """SELECT url, CASE WHEN page_id % 4 <> 3 THEN md5(html) END AS etag, CASE WHEN page_id % 4 <> 2 THEN page_id % 50 END AS last_modified, octet_length(encode(html)) AS size, html AS body
  FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1"""
VIEW_SQL["v_fetched"] = """SELECT url, CASE WHEN length(body) % 5 = 0 THEN 'old' ELSE etag END AS etag, CASE WHEN length(body) % 7 = 0 THEN -1 ELSE last_modified END AS last_modified, size,
  CASE WHEN length(body) % 3 = 0 THEN sha256(body || 'old') ELSE sha256(body) END AS page_hash FROM v_head WHERE length(body) % 11 <> 0"""


def v_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = read_table(spark, sf_dir, "pages"), F.col("page_id")
    heads = p.select(n, "url", F.when(n % 4 != 3, F.md5("html")).alias("etag"), F.when(n % 4 != 2, n % 50).alias("last_modified"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("body"))
    return latest.last_n(heads, ["url"], [F.col("page_id")], 1).drop("page_id")


def v_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("body")
    known = v_head(spark, sf_dir).where(n % 11 != 0)
    return known.select(
        "url", F.when(n % 5 == 0, "old").otherwise(F.col("etag")).alias("etag"), F.when(n % 7 == 0, -1).otherwise(F.col("last_modified")).alias("last_modified"), "size",
        F.sha2(F.when(n % 3 == 0, F.concat("body", F.lit("old"))).otherwise(F.col("body")), 256).alias("page_hash"),
    )


@query("""SELECT url, page_hash, CASE WHEN same THEN 'skip' WHEN new_hash IS NOT DISTINCT FROM old_hash THEN 'same' ELSE 'changed' END AS action FROM (
SELECT h.url, coalesce(h.etag = f.etag, h.last_modified = f.last_modified AND h.size = f.size, FALSE) AS same, sha256(h.body) AS new_hash, f.page_hash AS old_hash,
CASE WHEN same THEN old_hash ELSE new_hash END AS page_hash FROM v_head h LEFT JOIN v_fetched f USING (url))""")
def conditional_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are skipped by ETag, time and size, and of those fetched, which have changed by their hash."""
    heads = v_head(spark, sf_dir)
    decisions = fetching.decide(v_fetched(spark, sf_dir), heads.drop("body"))
    return fetching.fetched(decisions, heads.select("url", "body")).select("url", "page_hash", "action")


@query("""SELECT source, tick FROM (SELECT s_suppkey AS source, greatest(1, s_nationkey) AS every FROM supplier), LATERAL (SELECT unnest(range(0, 145)) AS tick) WHERE tick % every = 0""")
def source_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beats of a day, one each ten minutes, at which each source is polled by its own interval."""
    sources = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("beats"))
    return fetching.polls(spark.range(145).withColumnRenamed("id", "tick"), sources, F.col("beats"))


_CHECKS = "SELECT user_id AS job, event_id AS \"check\", k // 34 AS entities, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS documents, 60 AS total FROM v_log WHERE user_id IS NOT NULL"


@query(f"""WITH c AS ({_CHECKS}), r AS (SELECT *, documents >= 0.9 * total AS ready FROM c), open_ AS (SELECT *, lag(entities) OVER (PARTITION BY job ORDER BY "check") AS before FROM (SELECT *, coalesce(max(ready::INT) OVER (PARTITION BY job ORDER BY "check" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r) WHERE ended = 0),
i AS (SELECT *, sum(CASE WHEN entities = before THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY "check") AS island FROM open_),
e AS (SELECT *, row_number() OVER (PARTITION BY job, island ORDER BY "check") - 1 AS n FROM i)
SELECT job, "check", CASE WHEN ready THEN 'done' ELSE 'restart' END AS action FROM e WHERE ready OR n > 0 AND n % 5 = 0""")
def rebuild_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are restarted after five checks without new entities, and done at nine tenths of their documents."""
    by = Window.partitionBy("job").orderBy("check")
    checks = v_log(spark, sf_dir).where("user_id IS NOT NULL").select(F.col("user_id").alias("job"), F.col("event_id").alias("check"), F.floor(F.col("k") / 34).alias("entities"))
    return fetching.watchdog(checks.withColumn("documents", F.row_number().over(by)).withColumn("total", F.lit(60)))


@query("SELECT doc_id, row_number() OVER w AS version, lag(file_hash) OVER w AS previous_hash FROM v_document WINDOW w AS (PARTITION BY group_id, lang ORDER BY doc_id)")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with the hash before."""
    d = v_document(spark, sf_dir).withColumn("name", F.concat_ws("/", "group_id", "lang"))
    return sequences.version_chain(d, "name", ["doc_id"], "file_hash").select("doc_id", F.col("version").cast("long").alias("version"), "previous_hash")


@query("SELECT doc_id, filename FROM v_document ORDER BY file_size DESC, doc_id LIMIT 50 OFFSET 50")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: a page of the document list."""
    return v_document(spark, sf_dir).orderBy(F.desc("file_size"), "doc_id").offset(50).limit(50).select("doc_id", "filename")


@query("SELECT user_id, arg_min(kind, (k, event_id)) AS backend FROM v_log WHERE ok GROUP BY user_id")
def pick_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first healthy backend by priority."""
    return v_log(spark, sf_dir).where("ok").groupBy("user_id").agg(F.min_by("kind", F.struct("k", "event_id")).alias("backend"))


@query("SELECT plan, task, CAST(step AS INTEGER) AS level FROM (SELECT *, step - min(step) OVER (PARTITION BY plan) AS first FROM (SELECT task, plan, row_number() OVER (PARTITION BY plan ORDER BY task) - 1 AS step FROM v_task))")
def task_topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by the longest chain of tasks that they wait for."""
    t = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.floor(F.col("o_orderkey") / 5).alias("plan"))
    by = Window.partitionBy("plan").orderBy("task")
    edges = t.withColumn("needs", F.lag("task").over(by)).where(F.col("needs").isNotNull()).select("task", "needs")
    return t.join(sequences.task_levels(t.select("task"), edges), "task").select("plan", "task", "level")


@query("SELECT plan, min(task) AS first_task, count(*) AS tasks FROM v_task GROUP BY plan ORDER BY plan DESC LIMIT 20")
def plans_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest plans."""
    t = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.floor(F.col("o_orderkey") / 5).alias("plan"))
    return t.groupBy("plan").agg(F.min("task").alias("first_task"), F.count("*").alias("tasks")).orderBy(F.desc("plan")).limit(20)


@query("""WITH q AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(query, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(response, ' '), lambda x: x <> '')) AS b, length(response) - length(query) AS delta, sha256(query) <> sha256(response) AS changed FROM v_qa)
SELECT conv_id, turn, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed, CAST(delta AS BIGINT) AS size_delta, changed FROM q""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that two versions don't share, both ways, and the difference in size."""
    w = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    return v_qa(spark, sf_dir).select(
        "conv_id", "turn", F.size(F.array_except(w("response"), w("query"))).cast("long").alias("added"), F.size(F.array_except(w("query"), w("response"))).cast("long").alias("removed"),
        (F.length("response") - F.length("query")).cast("long").alias("size_delta"), (F.sha2("query", 256) != F.sha2("response", 256)).alias("changed"),
    )


@query("SELECT page_id, title FROM (SELECT page_id, title, row_number() OVER (PARTITION BY substr(title, 1, 80) || substr(html, 1, 80) ORDER BY page_id) AS place FROM v_page) WHERE place = 1")
def dedup_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One news item of each beginning of title and text."""
    key = F.concat(F.substring("title", 1, 80), F.substring("html", 1, 80))
    return latest.first_per(v_page(spark, sf_dir), [key], [F.col("page_id")]).select("page_id", "title")


@query("SELECT user_id, kind, k, max(event_id) AS event_id FROM v_log WHERE event_id % 2 = 0 OR value > 20 GROUP BY ALL")
def merge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and incoming entries together, the latest of each kind."""
    log = v_log(spark, sf_dir)
    kept, incoming = log.where("event_id % 2 = 0"), log.where("value > 20")
    return kept.unionByName(incoming).groupBy("user_id", "kind", "k").agg(F.max("event_id").alias("event_id"))


@query("""SELECT 'docs' AS result_type, doc_id AS id FROM documents WHERE contains(text, 'License') UNION ALL SELECT 'pages', page_id FROM v_page WHERE contains(title, 'th') UNION ALL SELECT 'graph', p_partkey FROM part WHERE contains(p_name, 'red')""")
def multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several kinds in one list."""
    d = read_table(spark, sf_dir, "documents").where(F.col("text").contains("License")).select(F.lit("docs").alias("result_type"), F.col("doc_id").alias("id"))
    p = v_page(spark, sf_dir).where(F.col("title").contains("th")).select(F.lit("pages").alias("result_type"), F.col("page_id").alias("id"))
    g = read_table(spark, sf_dir, "part").where(F.col("p_name").contains("red")).select(F.lit("graph").alias("result_type"), F.col("p_partkey").alias("id"))
    return d.unionByName(p).unionByName(g)


@query("SELECT user_id, kind, k, min(event_id) AS event_id FROM v_log GROUP BY ALL")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each key."""
    return v_log(spark, sf_dir).groupBy("user_id", "kind", "k").agg(F.min("event_id").alias("event_id"))


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_event, min(event_id) AS first_event FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM v_log)) GROUP BY user_id, s""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, Tx: sessions of a client, parted by half an hour of quiet; a debounce keeps the last event."""
    return v_log(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.min("event_id").alias("first_event")).select("user_id", "n", "last_event", "first_event")


@query("SELECT kind, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM v_log GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tx: tumbling hours."""
    return v_log(spark, sf_dir).groupBy("kind", F.window("ts", "1 hour").start.alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT kind, start, count(*) AS n FROM (SELECT kind, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM v_log) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tx: hours that begin every half hour."""
    return v_log(spark, sf_dir).groupBy("kind", F.window("ts", "1 hour", "30 minutes").start.alias("start")).agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(kind, (ts, event_id)) AS state, CASE arg_max(kind, (ts, event_id)) WHEN 'signup' THEN 10 WHEN 'view' THEN 30 WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 ELSE 0 END AS progress FROM v_log GROUP BY user_id")
def doc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each document and its progress."""
    s = v_log(spark, sf_dir).groupBy("user_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("state"))
    steps = F.create_map(*[F.lit(x) for kv in {"signup": 10, "view": 30, "click": 50, "purchase": 100}.items() for x in kv])
    return s.withColumn("progress", F.coalesce(steps[F.col("state")], F.lit(0)))


@query("SELECT page_id, new_hash, old_hash FROM (SELECT page_id, sha256(html) AS new_hash, lag(sha256(html)) OVER (PARTITION BY host ORDER BY page_id) AS old_hash FROM v_page) WHERE old_hash IS NULL OR old_hash <> new_hash")
def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that differ from the one before; the first is a change."""
    return changes_of(v_page(spark, sf_dir), "host", "page_id", "html").select("page_id", "new_hash", "old_hash")


@query("SELECT event_id, CASE WHEN ok THEN 'done' WHEN k < 20 THEN 'delay' WHEN k < 80 THEN 'retry' ELSE 'dead' END AS action, CASE WHEN NOT ok AND k >= 20 AND k < 80 THEN pow(2, k % 5) * 60 ELSE 0 END AS wait FROM v_log")
def classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do after an event: provider trouble waits, others are tried again with growing waits, then given up."""
    k, failed = F.col("k"), ~F.col("ok")
    retry = failed & (k >= 20) & (k < 80)
    action = F.when(F.col("ok"), "done").when(k < 20, "delay").when(retry, "retry").otherwise("dead")
    return v_log(spark, sf_dir).select("event_id", action.alias("action"), F.when(retry, F.pow(F.lit(2.0), k % 5) * 60).otherwise(0.0).alias("wait"))


@query("SELECT page_id, CAST(ceil(row_number() OVER (PARTITION BY host ORDER BY page_id) / 5.0) AS BIGINT) AS batch FROM v_page")
def fetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Politeness batches of five fetches for each host."""
    by = Window.partitionBy("host").orderBy("page_id")
    return v_page(spark, sf_dir).select("page_id", F.ceil(F.row_number().over(by) / 5.0).alias("batch"))


@query("""SELECT o_custkey AS key, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, CAST(max(o_orderkey) AS BIGINT) AS top FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1""")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K5: old rows and new ones merged, the latest of each key."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    merged = latest.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["key"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return merged.select("key", "status").join(o.groupBy("key").agg(F.max("o_orderkey").alias("top")), "key")


@query("""SELECT p_type AS category, p_partkey AS key, '{"key":' || p_partkey || ',"value":"' || p_name || '"}' AS entry FROM part""")
def config_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's keys and values as backup entries, one line of JSON for each."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("category"), F.col("p_partkey").alias("key"), F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))).alias("entry"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def transcript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a transcript."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript"))
