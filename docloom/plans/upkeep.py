"""Upkeep of documents, graph and plans: merges in full, retries, settings, rebuild rules, usage, file names, sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.adapters import apply_or
from docloom.functions import text as T
from docloom.operators import execution, extraction, graph, latest
from docloom.operators import retrieval as R
from docloom.plans._catalog import query
from docloom.plans.views import v_document, v_log, v_mention, v_page, v_point
from docloom.sources.tableset import TableSet
from docloom.storage import broadcast_small, new_path, read_table, spread, stage


@query("""WITH e AS (SELECT name, type, round(list_reduce(list(confidence ORDER BY doc_id, chunk_seq, confidence), lambda a, x: (a + x) / 2), 6) AS confidence, max(struct_pack(doc_id := doc_id, chunk_seq := chunk_seq)).doc_id * 10 + max(struct_pack(doc_id := doc_id, chunk_seq := chunk_seq)).chunk_seq AS last_chunk FROM v_mention GROUP BY name, type)
SELECT name, type, confidence, CAST(last_chunk AS BIGINT) AS last_chunk, doc_id FROM e JOIN (SELECT DISTINCT name, type, doc_id FROM v_mention) USING (name, type)""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged in order: folded confidence, the properties of the last mention, and each source document
    as a row, as an entity may be in a third of all."""
    m = v_mention(spark, sf_dir)
    folds = graph.aggregate_folds(m).select("name", "type", F.round("confidence", 6).alias("confidence"))
    last = m.groupBy("name", "type").agg(F.max(F.struct("doc_id", "chunk_seq")).alias("l")).select("name", "type", (F.col("l.doc_id") * 10 + F.col("l.chunk_seq")).alias("last_chunk"))
    entities = stage(folds.join(last, ["name", "type"]), "entities")
    return latest.look_up(m.select("name", "type", "doc_id").distinct(), entities, ["name", "type"], "doc_id").select("name", "type", "confidence", "last_chunk", "doc_id")


@query("""SELECT name, type, doc_id, count(*) AS times FROM (SELECT name, type, doc_id FROM v_mention UNION ALL SELECT name, type, doc_id FROM v_mention WHERE doc_id % 2 = 0) GROUP BY ALL""")
def entity_docs_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other merge of lists, plain concatenation: of two batches of mentions, each document as often as it comes."""
    m = v_mention(spark, sf_dir).select("name", "type", "doc_id")
    return m.unionByName(m.where("doc_id % 2 = 0")).groupBy("name", "type", "doc_id").agg(F.count("*").alias("times"))


@query("""WITH t AS (SELECT o_orderkey AS task, o_orderkey // 5 AS plan, o_orderkey % 5 AS step FROM orders),
a AS (SELECT l_orderkey AS task, bool_or(l_quantity > 45) AS ok, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
own AS (SELECT task, plan, step, CASE WHEN ok THEN 'done' WHEN n >= 3 THEN 'failed' ELSE 'pending' END AS status FROM t LEFT JOIN a USING (task)),
marked AS (SELECT *, coalesce(max((status = 'failed')::INT) OVER (PARTITION BY plan ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM own)
SELECT task, CASE WHEN status = 'pending' AND bad = 1 THEN 'blocked' ELSE status END AS status FROM marked""")
def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after at most three tries each; what depends on a failed one, however far, is blocked."""
    tasks = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    edges = tasks.where("task % 5 > 0").select("task", (F.col("task") - 1).alias("needs"))
    edges = edges.join(tasks.select(F.col("task").alias("needs")), "needs", "left_semi").select("task", "needs")
    tries = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 45).alias("ok"))
    return execution.states(tasks, edges, tries, 3)


@query("""SELECT kind, value FROM (SELECT p_type AS preset, p_brand AS kind, arg_max(p_name, p_partkey) AS value FROM part GROUP BY ALL) WHERE preset = (SELECT p_type FROM part WHERE p_size = 50 ORDER BY p_partkey DESC LIMIT 1)""")
def schema_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain schema in force: edits and switches are logs, the latest edit of each key and the latest switch win."""
    p = read_table(spark, sf_dir, "part")
    edits = p.select(F.col("p_type").alias("preset"), F.col("p_brand").alias("kind"), F.col("p_name").alias("value"), F.col("p_partkey").alias("at"))
    switches = p.where("p_size = 50").select(F.col("p_type").alias("preset"), F.col("p_partkey").alias("at"))
    return execution.settings_in_force(edits, switches).select("kind", "value")


@query("""SELECT *, in_graph < 0.8 * completed OR entities < 10 AS rebuild FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, (SELECT count(DISTINCT doc_id) FROM v_mention JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'F' AND o_orderkey % 4 > 0) AS in_graph,
(SELECT count(*) FROM v_entity) AS entities FROM orders)""")
def rebuild_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the graph is rebuilt at start: under 80 % of the completed documents in it, or under ten entities."""
    done = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    m = v_mention(spark, sf_dir)
    in_graph = m.join(done.where("doc_id % 4 > 0"), "doc_id", "left_semi").agg(F.countDistinct("doc_id").alias("in_graph"))
    entities = m.select("name", "type").distinct().agg(F.count("*").alias("entities"))
    one = done.agg(F.count("*").alias("completed")).join(F.broadcast(in_graph)).join(F.broadcast(entities))  # one row each
    return one.withColumn("rebuild", (F.col("in_graph") < 0.8 * F.col("completed")) | (F.col("entities") < 10))


@query("""SELECT user_id AS container, round(100.0 * arg_max(k, (ts, event_id)) / 128, 4) AS memory_percent, CAST(coalesce(sum(k) FILTER (kind = 'view'), 0) AS BIGINT) AS received, CAST(coalesce(sum(k) FILTER (kind = 'click'), 0) AS BIGINT) AS sent,
CAST(coalesce(sum(k) FILTER (kind IN ('purchase', 'signup')), 0) AS BIGINT) AS blocks FROM v_log GROUP BY user_id""")
def container_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory in percent of its limit at the last sample, and sums of network and block counters."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("k")).otherwise(0))
    last = F.max_by("k", F.struct("ts", "event_id"))
    return v_log(spark, sf_dir).groupBy(F.col("user_id").alias("container")).agg(
        F.round(100.0 * last / 128, 4).alias("memory_percent"), of("view").alias("received"), of("click").alias("sent"), of("purchase", "signup").alias("blocks")
    )


@query(r"""SELECT page_id, CASE WHEN b IN ('', '.', '..') THEN 'file' ELSE b END AS filename, lower(regexp_extract(b, '[^.]([.][^.]*)$', 1)) AS suffix FROM (SELECT page_id, regexp_extract(replace(replace(host || '\up/../' || title || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '/' ELSE '' END, chr(0), ''), '\', '/'), '([^/]*)$', 1) AS b FROM v_page)""")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an upload's name without its path, of either kind of slash, and without NUL; and its suffix."""
    given = F.concat("host", F.lit("\\up/../"), "title", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, "/").otherwise(""))
    safe = v_page(spark, sf_dir).select("page_id", T.base_name(given).alias("filename"))
    return safe.select("page_id", "filename", T.suffix(F.col("filename")).alias("suffix"))


@query(r"""SELECT event_id, CAST(json_extract_string(regexp_extract('types: [' || props || ', 7] and [8]', '\[.*?\]', 0, 's'), '$[0].k') AS BIGINT) AS k, regexp_extract('types: [' || props || ', 7] and [8]', '\[.*?\]', 0, 's') AS first_array FROM events""")
def first_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the first JSON array in an answer, and a field of its first element."""
    answer = F.concat(F.lit("types: ["), "props", F.lit(", 7] and [8]"))
    e = read_table(spark, sf_dir, "events").select("event_id", T.json_array(answer).alias("first_array"))
    return e.select("event_id", F.get_json_object("first_array", "$[0].k").cast("long").alias("k"), "first_array")


_COS = "CASE WHEN list_dot_product(p.dense, p.dense) = 0 THEN 0.0 ELSE round(list_dot_product(p.dense, q.dense) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(q.dense, q.dense))), 6) END"


@query(f"""SELECT query_id, rank, doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) ELSE coalesce(filename, substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) END AS label, score FROM (
SELECT item_id AS query_id, p.id AS doc_id, {_COS} AS score, row_number() OVER (PARTITION BY item_id ORDER BY {_COS} DESC, p.id) AS rank FROM benchmark JOIN v_point q ON q.id = item_id, v_point p) LEFT JOIN v_document USING (doc_id) WHERE rank <= 5""")
def chat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of an answer by file name, or by the beginning of the id where a record or its name lacks."""
    p = v_point(spark, sf_dir)
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(p, F.col("id") == F.col("query_id")).select("query_id", "dense")
    hits = stage(R.vector_topk_each(p, asked, 5), "hits")
    wanted = hits.select("doc_id").distinct()
    names = v_document(spark, sf_dir).select("doc_id", "filename").where("doc_id % 3 <> 0").join(broadcast_small(wanted), "doc_id", "left_semi")
    label = F.coalesce("filename", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12))
    return hits.join(names, "doc_id", "left").select("query_id", "rank", "doc_id", label.alias("label"), "score")


@query("""SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY kind, k ORDER BY ts, event_id)) < 86400000000, FALSE) AS cached FROM v_log""")
def embedding_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: whether a text's embedding is in the cache: put there, at each use, less than 24 hours before."""
    by = Window.partitionBy("kind", "k").orderBy("ts", "event_id")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))
    return v_log(spark, sf_dir).select("event_id", F.coalesce(age < 86_400_000_000, F.lit(False)).alias("cached"))


@query("""WITH known AS (SELECT * FROM (VALUES ('economy'), ('promo'), ('contract'), ('other')) t(kind)), d AS (SELECT p_partkey AS doc_id, lower(trim(p_type || CASE WHEN p_partkey % 10 = 0 THEN ' of a kind that no taxonomy would hold' ELSE ' ' END)) AS said FROM part)
SELECT doc_id, CASE WHEN said IN (SELECT kind FROM known) OR length(said) < 40 THEN said ELSE 'other' END AS kind, said NOT IN (SELECT kind FROM known) AND length(said) < 40 AS is_new FROM d""")
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's detected type: of the taxonomy, or a new one if its name is short, or else other."""
    said = F.lower(F.trim(F.concat("p_type", F.when(F.col("p_partkey") % 10 == 0, " of a kind that no taxonomy would hold").otherwise(" "))))
    d = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), said.alias("said"))
    known = F.col("said").isin("economy", "promo", "contract", "other")
    short = F.length("said") < 40
    return d.select("doc_id", F.when(known | short, F.col("said")).otherwise("other").alias("kind"), (~known & short).alias("is_new"))


_CORE = {"email": "[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "number": "[0-9]{4,}"}
_RELATIONS = {("email", "number"): "REACHED_AT", ("number", "email"): "REACHED_AT", ("date", "number"): "DATED", ("number", "number"): "LISTED_WITH", ("email", "email"): "WRITES_TO"}
_EXTENDED = {"license": "[Ll]icense", "url": "https?://[A-Za-z0-9./_-]+", "acronym": "[A-Z]{3,}"}
_CASE = lambda patterns, c: " ".join(["CASE", *(f"WHEN regexp_full_match({c}, '{p}') THEN '{k}'" for k, p in patterns.items()), "END"])


@query(rf"""WITH d AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) >= 20 AS long, string_split_regex(coalesce(text, ''), '{extraction.SENTENCE}') AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS said, generate_subscripts(s, 1) AS line FROM d WHERE long),
f AS (SELECT *, regexp_extract_all(said, '{extraction.any_of(_CORE)}') AS found FROM e),
n AS (SELECT doc_id, line, name, {_CASE(_CORE, "name")} AS kind, place FROM (SELECT doc_id, line, unnest(found) AS name, generate_subscripts(found, 1) AS place FROM f)),
p AS (SELECT doc_id, name, kind, lead(name) OVER w AS target, lead(kind) OVER w AS target_kind FROM n WINDOW w AS (PARTITION BY doc_id, line ORDER BY place)),
r AS (SELECT doc_id, CASE kind || '>' || target_kind {" ".join(f"WHEN '{a}>{b}' THEN '{k}'" for (a, b), k in _RELATIONS.items())} END AS kind, name, target FROM p),
x AS (SELECT doc_id, unnest(regexp_extract_all(said, '{extraction.any_of(_EXTENDED)}')) AS name FROM e)
SELECT doc_id, what, kind, name, target, count(*) AS times FROM (SELECT doc_id, 'core' AS what, kind, name, NULL::VARCHAR AS target FROM n
UNION ALL SELECT doc_id, 'fact', NULL, said, NULL FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM f WHERE len(found) > 0) WHERE k <= 3
UNION ALL SELECT doc_id, 'relation', kind, name, target FROM r WHERE kind IS NOT NULL
UNION ALL SELECT doc_id, 'extended', {_CASE(_EXTENDED, "name")}, name, NULL FROM x
UNION ALL SELECT doc_id, 'warning', NULL, 'too short', NULL FROM d WHERE NOT long) GROUP BY ALL""")
def extract_three_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core entities and facts, relations of neighbours in a sentence, further entities; by patterns, over whole texts."""
    return extraction.three_passes(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), _CORE, _RELATIONS, _EXTENDED, gate="[0-9@]")


def vowel_shares(texts: pd.Series) -> pd.Series:
    """A small embedding that refuses what is longer than its window, as models do."""
    if (texts.str.len() > 8000).any():
        raise ValueError("over 8,000 characters")
    return pd.Series([[t.count(v) / max(1, len(t)) for v in "aeio"] for t in texts])


@query("""SELECT doc_id, length(text) > 8000 OR NOT regexp_matches(text, '[aeio]') AS zero, round(CASE WHEN length(text) > 8000 THEN 0 ELSE (length(text) - length(replace(text, 'a', ''))) / greatest(1, length(text)) END, 6) AS a,
round(CASE WHEN length(text) > 8000 THEN 0 ELSE (length(text) - length(replace(text, 'e', ''))) / greatest(1, length(text)) END, 6) AS e FROM documents""")
def embedding_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: texts embedded in groups of ten; one that the service refuses gets the zero vector and costs no other one its own."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    v = apply_or(d, "text", "v", vowel_shares, "array<double>", [0.0] * 4)
    return v.select("doc_id", F.forall("v", lambda x: x == 0).alias("zero"), F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("e"))


_GONE = "(SELECT doc_id FROM v_document WHERE status = 'failed')"


@query(f"""SELECT 'row' AS what, doc_id, 1 AS n FROM v_document WHERE doc_id NOT IN {_GONE} UNION ALL SELECT 'vector', id, 1 FROM v_point WHERE id NOT IN {_GONE}
UNION ALL SELECT 'mention', doc_id, count(*) FROM v_mention WHERE doc_id NOT IN {_GONE} GROUP BY 2""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: failed documents deleted from rows, vectors and graph at once, by one manifest; what the three tables hold then."""
    d = v_document(spark, sf_dir).select("doc_id", "status")
    first = {"row": d, "vector": v_point(spark, sf_dir).select(F.col("id").alias("doc_id"), "label"), "mention": v_mention(spark, sf_dir).select("doc_id", "name", "type")}
    tables = TableSet(spark, new_path(spark, "tables"))
    tables.commit({name: lambda _, rows=rows: rows for name, rows in first.items()})
    tables.delete_documents(d.where("status = 'failed'").select("doc_id"), dict.fromkeys(first, "doc_id"), "failed")
    left = {name: tables.read(name) for name in first}
    counted = left["mention"].groupBy("doc_id").agg(F.count("*").alias("n"))
    each = [left[k].select(F.lit(k).alias("what"), "doc_id", F.lit(1).cast("long").alias("n")) for k in ("row", "vector")]
    return each[0].unionByName(each[1]).unionByName(counted.select(F.lit("mention").alias("what"), "doc_id", "n"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
SELECT coalesce(l.doc_id, p.id) AS id, CAST(CASE WHEN l.doc_id IS NULL THEN p.label ELSE l.quality END AS BIGINT) AS label, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version FROM v_point p FULL JOIN l ON l.doc_id = p.id""")
def points_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a batch of points put into the collection: known ids are replaced, new ones join; the batch sent again changes nothing."""
    p = v_point(spark, sf_dir).select("id", F.col("label").cast("long").alias("label"), F.lit(0).cast("long").alias("version"))
    new = read_table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("long").alias("label")).withColumn("version", F.lit(1).cast("long"))
    tables, newest = TableSet(spark, new_path(spark, "points")), [F.desc("version")]
    tables.put("points", p, ["id"], newest)
    for _ in range(2):
        tables.put("points", new, ["id"], newest, "relabelled")
    return tables.read("points")
