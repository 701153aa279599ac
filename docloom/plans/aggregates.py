"""Aggregations: statistics of documents, logs, experiments, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import experiments, latest, sequences
from docloom.operators.graph import aggregate_folds
from docloom.plans._catalog import VIEW_SQL, query
from docloom.plans.views import v_document, v_entity, v_log, v_mention, v_page, v_point, v_qa, v_relation
from docloom.storage import read_table

#: A record's metrics in long form: one row for each response and metric.
VIEW_SQL["v_metric"] = """SELECT conv_id * 100 + turn AS record, conv_id % 3 AS model, CASE k WHEN 0 THEN 'relevance' WHEN 1 THEN 'fluency' ELSE 'completeness' END AS metric,
  CASE k WHEN 0 THEN CASE WHEN contains(response, substr(query, 1, 3)) THEN 1.0 ELSE 0.5 END WHEN 1 THEN least(1.0, length(response) / 800.0) ELSE least(1.0, length(response) * 0.2 / greatest(1, length(query))) END AS score
  FROM v_qa, (SELECT unnest(range(0, 3)) AS k)"""


def v_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v_qa(spark, sf_dir)
    hit = F.expr("contains(response, substr(query, 1, 3))")
    n = F.length("response")
    scores = {"relevance": F.when(hit, 1.0).otherwise(0.5), "fluency": F.least(F.lit(1.0), n / 800.0), "completeness": F.least(F.lit(1.0), n * 0.2 / F.greatest(F.lit(1), F.length("query")))}
    wide = q.select((F.col("conv_id") * 100 + F.col("turn")).alias("record"), (F.col("conv_id") % 3).alias("model"), *[s.alias(k) for k, s in scores.items()])
    return wide.unpivot(["record", "model"], list(scores), "metric", "score")


@query("SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM v_document GROUP BY 1")
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents by status."""
    return v_document(spark, sf_dir).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT 'documents' AS what, (SELECT count(DISTINCT doc_id) FROM v_mention) AS n UNION ALL SELECT 'chunks', (SELECT count(DISTINCT chunk_id) FROM v_mention)
UNION ALL SELECT 'entities', (SELECT count(*) FROM v_entity) UNION ALL SELECT 'shared', (SELECT count(*) FROM v_entity WHERE n_docs > 1) UNION ALL SELECT 'relations', (SELECT count(*) FROM v_relation) + (SELECT count(*) FROM v_mention)""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph; relations count all edges."""
    m, e, r = v_mention(spark, sf_dir), v_entity(spark, sf_dir), v_relation(spark, sf_dir)
    base = m.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("mentions"))
    more = e.agg(F.count("*").alias("entities"), F.count_if(F.col("n_docs") > 1).alias("shared"))
    edges = r.agg(F.count("*").alias("domain"))
    one = base.join(F.broadcast(more)).join(F.broadcast(edges)).withColumn("relations", F.col("domain") + F.col("mentions"))  # one row each
    return one.select("documents", "chunks", "entities", "shared", "relations").unpivot([], ["documents", "chunks", "entities", "shared", "relations"], "what", "n")


@query("""SELECT name, type, round(list_reduce(list(confidence ORDER BY doc_id, chunk_seq, confidence), lambda a, x: (a + x) / 2), 6) AS confidence FROM v_mention GROUP BY name, type""")
def entity_confidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: confidence after each mention is the mean of the one before and the new one, in order."""
    return aggregate_folds(v_mention(spark, sf_dir)).select("name", "type", F.round("confidence", 6).alias("confidence"))


@query("SELECT DISTINCT name, type, doc_id FROM v_mention")
def entity_source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of documents behind an entity, one row for each, as an entity may be in a third of all."""
    return v_mention(spark, sf_dir).select("name", "type", "doc_id").distinct()


@query("""SELECT field, count(*) AS occurrences, string_agg(DISTINCT kind_of, ',' ORDER BY kind_of) AS types, array_to_string(list_sort(list(DISTINCT value))[1:3], ',') AS samples FROM (
SELECT field, value, CASE WHEN regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') THEN 'number' WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind_of FROM (
SELECT unnest(['kind', 'ok', 'k']) AS field, unnest([kind, CASE WHEN ok THEN 'true' ELSE 'false' END, CAST(k AS VARCHAR)]) AS value FROM (SELECT * FROM v_log ORDER BY event_id LIMIT 100))) WHERE value IS NOT NULL GROUP BY field""")
def payload_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 100 points, each payload field's occurrences, types and three samples: a look at the shape of it."""
    flat = v_log(spark, sf_dir).orderBy("event_id").limit(100).select(F.explode(F.map_from_arrays(F.array(F.lit("kind"), F.lit("ok"), F.lit("k")), F.array("kind", F.col("ok").cast("string"), F.col("k").cast("string")))).alias("field", "value"))
    kind = F.when(F.col("value").rlike("^-?[0-9]+([.][0-9]+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").otherwise("string")
    some = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ",")
    return flat.where(F.col("value").isNotNull()).groupBy("field").agg(F.count("*").alias("occurrences"), some(kind, 3).alias("types"), some(F.col("value"), 3).alias("samples"))


@query("SELECT label, count(*) AS n_points, CAST(max(len(dense)) AS INTEGER) AS dims FROM v_point GROUP BY label")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and dimensions of each collection."""
    return v_point(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_points"), F.max(F.size("dense")).alias("dims"))


@query("""SELECT count(*) AS total, count_if(kind = 'purchase') AS downloaded, count_if(NOT ok) AS failed, count_if(kind = 'view') AS processed, CAST(sum(k) AS BIGINT) AS items_found, count(DISTINCT user_id) AS sources FROM v_log""")
def monitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor totals."""
    return v_log(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(F.col("kind") == "purchase").alias("downloaded"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("kind") == "view").alias("processed"), F.sum("k").alias("items_found"), F.countDistinct("user_id").alias("sources"),
    )


@query("SELECT metric, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY record DESC) AS place FROM v_metric) WHERE place <= 100 GROUP BY metric")
def avg_metrics_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each metric over its last 100 records."""
    return latest.last_n(v_metric(spark, sf_dir), ["metric"], [F.desc("record")], 100).groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean"))


@query("""SELECT m.model, round(coalesce(avg(coalesce(x.score, 0)), 0), 6) AS mean FROM (SELECT unnest(range(0, 5)) AS model) m LEFT JOIN v_metric x ON x.model = m.model AND x.metric = 'fluency' GROUP BY m.model""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed model's mean; 0 for models without records and for missing values."""
    models = spark.range(5).select(F.col("id").alias("model"))
    x = v_metric(spark, sf_dir).where("metric = 'fluency'").select("model", "score")
    return models.join(x, "model", "left").groupBy("model").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean"))


@query("SELECT 'quality' AS metric, count(*) AS n, round(avg((quality * 4 + 1) / 5.0), 6) AS mean FROM labels UNION ALL SELECT 'toxic', count(*), round(avg((toxic * 4 + 1) / 5.0), 6) FROM labels")
def annotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean annotation of each metric, as a share of the scale."""
    flat = read_table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "metric", "v")
    return flat.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg((F.col("v") * 4 + 1) / 5.0), 6).alias("mean"))


_AB = "SELECT user_id % 3 AS variant, kind AS metric, value FROM v_log"


def _ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_log(spark, sf_dir).select((F.col("user_id") % 3).alias("variant"), F.col("kind").alias("metric"), "value")


@query(f"SELECT variant, metric, count(*) AS samples, round(avg(value), 4) AS mean FROM ({_AB}) GROUP BY variant, metric")
def ab_variant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and mean of each variant and metric."""
    return experiments.variant_means(_ab(spark, sf_dir)).select("variant", "metric", "samples", F.round("mean", 4).alias("mean"))


@query(f"SELECT metric, variant AS winner FROM (SELECT metric, variant, row_number() OVER (PARTITION BY metric ORDER BY round(avg(value), 4) DESC, variant) AS place FROM ({_AB}) GROUP BY metric, variant) WHERE place = 1")
def ab_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant with the highest mean; the first of equals."""
    return experiments.winners(_ab(spark, sf_dir))


@query(f"""SELECT metric, count(*) AS variants, min(n) AS fewest, round(max(m) - min(m), 4) AS spread, count(*) >= 2 AND min(n) >= 30 AND max(m) - min(m) > 0.05 AS significant
FROM (SELECT metric, variant, count(*) AS n, round(avg(value), 4) AS m FROM ({_AB}) GROUP BY metric, variant) GROUP BY metric""")
def ab_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether variants differ by the rule: two variants, 30 samples each, means apart by 0.05."""
    return experiments.significance(_ab(spark, sf_dir))


@query("""SELECT user_id AS backend, count(*) AS total, count_if(ok) AS succeeded, count_if(NOT ok) AS failed, round(100.0 * count_if(ok) / count(*), 4) AS success_rate, round(avg(value), 4) AS mean_latency FROM v_log GROUP BY user_id""")
def backend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, success rate and mean latency of each backend."""
    n, ok = F.count("*"), F.count_if("ok")
    return v_log(spark, sf_dir).groupBy(F.col("user_id").alias("backend")).agg(n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"), F.round(100.0 * ok / n, 4).alias("success_rate"), F.round(F.avg("value"), 4).alias("mean_latency"))


_TASK = "SELECT o_custkey AS plan_id, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_totalprice / 1000.0 AS seconds FROM orders"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("task_id"), s.alias("status"), (F.col("o_totalprice") / 1000.0).alias("seconds"))


@query(f"""SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, round(100.0 * count_if(status = 'completed') / count(*), 4) AS success_rate, round(avg(seconds), 2) AS mean_seconds FROM ({_TASK})""")
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed tasks."""
    done = F.count_if(F.col("status") == "completed")
    return _tasks(spark, sf_dir).agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(100.0 * done / F.count("*"), 4).alias("success_rate"), F.round(F.avg("seconds"), 2).alias("mean_seconds"))


@query(f"""SELECT plan_id, count(*) AS tasks, count_if(status = 'completed') AS completed, count_if(status = 'pending') AS pending, count_if(status = 'failed') AS failed, round(100.0 * count_if(status = 'completed') / count(*), 2) AS percent FROM ({_TASK}) GROUP BY plan_id""")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by status of each plan and how far it is."""
    n = lambda s: F.count_if(F.col("status") == s)
    return _tasks(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("tasks"), n("completed").alias("completed"), n("pending").alias("pending"), n("failed").alias("failed"), F.round(100.0 * n("completed") / F.count("*"), 2).alias("percent"))


@query("""SELECT user_id, count(*) AS steps, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros, bool_or(kind = 'purchase') AS completed, count_if(NOT ok) AS errors,
arg_min(kind, (ts, event_id)) AS first_step, arg_max(kind, (ts, event_id)) AS last_step FROM v_log GROUP BY user_id""")
def process_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, span, first and last step, completion and errors of each document's log."""
    at = F.struct("ts", "event_id")
    return v_log(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("steps"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("micros"),
        F.bool_or(F.col("kind") == "purchase").alias("completed"), F.count_if(~F.col("ok")).alias("errors"),
        F.min_by("kind", at).alias("first_step"), F.max_by("kind", at).alias("last_step"),
    )


@query("""SELECT d.lang, count_if(d.status = 'completed') AS completed, count_if(d.status = 'completed' AND l.quality IS NOT NULL) AS typed, count_if(d.status = 'completed' AND l.quality IS NULL) AS untyped FROM v_document d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed documents with and without a type."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    done = F.col("status") == "completed"
    return v_document(spark, sf_dir).join(lab, "doc_id", "left").groupBy("lang").agg(F.count_if(done).alias("completed"), F.count_if(done & F.col("quality").isNotNull()).alias("typed"), F.count_if(done & F.col("quality").isNull()).alias("untyped"))


@query("SELECT user_id % 4 AS worker, count_if(kind = 'click') AS active, count_if(kind = 'view') AS reserved, count_if(kind = 'signup') AS scheduled FROM v_log GROUP BY 1")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each worker's queues."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return v_log(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("worker")).agg(n("click").alias("active"), n("view").alias("reserved"), n("signup").alias("scheduled"))


_RULE_SQL = " UNION ALL ".join(f"SELECT {i} AS rule, '{k}' AS class, '(?i){p}' AS pattern, {w} AS weight" for i, (k, p, w) in enumerate(T.RULES))


@query(f"""WITH scored AS (SELECT doc_id, class, sum(weight) AS score, min(rule) AS first FROM documents, ({_RULE_SQL}) r WHERE regexp_matches(substr(text, 1, {T.RULES_READ}), r.pattern) GROUP BY doc_id, class),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, first) AS place FROM scored)
SELECT d.doc_id, coalesce(class, 'other') AS class, round(least(1.0, coalesce(score, 0)), 6) AS confidence, coalesce(score, 0) > 0.5 AS tagged FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.place = 1""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rules of eight types; the type with the highest sum, the first of equals; confidence 1 at most."""
    from docloom.operators.classify import by_rules

    return by_rules(read_table(spark, sf_dir, "documents"), T.RULES, read=T.RULES_READ).select("doc_id", "class", F.round("confidence", 6).alias("confidence"), "tagged")


@query("""SELECT event_id, round(CASE WHEN prev_total IS NULL OR total <= prev_total THEN 0 ELSE 100.0 * (used - prev_used) / (total - prev_total) END, 4) AS cpu_percent FROM (
SELECT event_id, used, total, lag(used) OVER w AS prev_used, lag(total) OVER w AS prev_total FROM (SELECT event_id, user_id, ts, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used, 200 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM v_log) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def cpu_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use between two samples of running counters."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = v_log(spark, sf_dir).select("event_id", "user_id", "ts", F.sum("k").over(so_far).alias("used"), (200 * F.row_number().over(by)).alias("total"))
    c = c.withColumn("pu", F.lag("used").over(by)).withColumn("pt", F.lag("total").over(by))
    share = F.when(F.col("pt").isNull() | (F.col("total") <= F.col("pt")), 0.0).otherwise(100.0 * (F.col("used") - F.col("pu")) / (F.col("total") - F.col("pt")))
    return c.select("event_id", F.round(share, 4).alias("cpu_percent"))


@query("""WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 1e300]) AS le), c AS (SELECT kind, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 ELSE 1e300 END AS le, count(*) AS n FROM v_log GROUP BY 1, 2)
SELECT kind, CAST(le AS DOUBLE) AS le, CAST(sum(n) OVER (PARTITION BY kind ORDER BY le) AS BIGINT) AS cumulative FROM c""")
def http_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram buckets by label."""
    bucket = T.histogram_bucket(F.col("value"), [1.0, 5.0, 10.0, 50.0]).otherwise(1e300)
    counts = v_log(spark, sf_dir).groupBy("kind", bucket.alias("le")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("kind").orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("kind", "le", F.sum("n").over(by).alias("cumulative"))


@query("SELECT kind, time_bucket(INTERVAL 5 MINUTE, ts) AS start, round(count(*) / 300.0, 8) AS rate FROM v_log GROUP BY 1, 2")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second in windows of five minutes."""
    return v_log(spark, sf_dir).groupBy("kind", F.window("ts", "5 minutes").start.alias("start")).agg(F.round(F.count("*") / 300.0, 8).alias("rate"))


@query("SELECT kind, round(quantile_cont(value, 0.95), 6) AS p95 FROM v_log GROUP BY kind")
def p95_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 95th percentile of each kind."""
    return sequences.exact_percentile(v_log(spark, sf_dir), "kind", "value", 0.95).select("kind", F.round("percentile", 6).alias("p95"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, done, total, round(100.0 * done / total, 4) AS percent, CAST(ceil((total - done) / greatest(1, per_day)) AS BIGINT) AS days_left FROM (
SELECT ts, per_day, CAST(sum(per_day) OVER (ORDER BY ts) AS BIGINT) AS done, CAST(sum(per_day) OVER () AS BIGINT) AS total FROM (SELECT date_trunc('day', ts) AS ts, count(*) AS per_day FROM v_log GROUP BY 1))""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent done and time left at each day's rate."""
    days = v_log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("per_day"))
    every = Window.partitionBy(F.lit(1))
    so_far = every.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = days.select("day", "per_day", F.sum("per_day").over(so_far).alias("done"), F.sum("per_day").over(every).alias("total"))  # a row a day
    left = F.ceil((F.col("total") - F.col("done")) / F.greatest(F.lit(1), F.col("per_day")))
    return d.select("day", "done", "total", F.round(100.0 * F.col("done") / F.col("total"), 4).alias("percent"), left.alias("days_left"))


@query("SELECT kind, count(*) AS n, count_if(ok) AS succeeded, count(DISTINCT user_id) AS users FROM v_log GROUP BY kind")
def audit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events by type."""
    return v_log(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("succeeded"), F.countDistinct("user_id").alias("users"))


@query("""WITH q AS (SELECT conv_id, turn, response, list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> '')) AS qw, list_distinct(list_filter(string_split(lower(response), ' '), lambda x: x <> '')) AS rw, length(query) AS nq, length(response) AS nr,
len(list_filter(string_split(response, ' '), lambda x: x <> '')) AS words, len(list_filter(string_split(response, '.'), lambda x: trim(x) <> '')) AS sentences FROM v_qa)
SELECT conv_id, turn, round(least(1.0, 2.0 * len(list_intersect(qw, rw)) / greatest(1, len(qw))), 6) AS relevance, CASE WHEN sentences = 0 THEN 0.0 WHEN sentences = 1 THEN 0.5 ELSE least(1.0, sentences / 10.0) END AS coherence,
least(1.0, words / 20.0) AS fluency, round(least(1.0, nr / greatest(1, nq) / 5.0), 6) AS completeness, 0.7 AS faithfulness, 0.2 AS hallucination_rate FROM q""")
def quality_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic quality metrics of each answer."""
    from docloom.functions.quality import automatic

    return automatic(v_qa(spark, sf_dir), "query", "response").select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("relevance", "completeness")], "coherence", "fluency", "faithfulness", "hallucination_rate")


@query("SELECT page_id, host, count(*) OVER (PARTITION BY host) AS n_host FROM v_page")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with how many their host has."""
    p = v_page(spark, sf_dir)
    return latest.look_up(p, p.groupBy("host").agg(F.count("*").alias("n_host")), ["host"], "page_id").select("page_id", "host", "n_host")
