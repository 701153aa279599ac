"""The library's concepts, projected on the driver's tables: as DataFrames here, as SQL in VIEW_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.graph import merge_entities
from docloom.plans._catalog import VIEW_SQL
from docloom.storage import read_table

VIEW_SQL["v_document"] = """SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, 'doc_' || doc_id || '.txt' AS filename, sha256(text) AS file_hash,
  CAST(octet_length(encode(text)) AS BIGINT) AS file_size, source AS group_id, lang, text,
  CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN NULL ELSE 'completed' END AS status FROM documents"""
VIEW_SQL["v_log"] = """SELECT event_id, ts, user_id, event_type AS kind, event_type <> 'error' AS ok, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
VIEW_SQL["v_mention"] = """SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber AS chunk_seq, p_brand AS name, p_type AS type,
  round(1 - l_discount, 2) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey"""
VIEW_SQL["v_entity"] = """SELECT name, type, round(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS BIGINT) / (100.0 * count(*)), 6) AS confidence, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM v_mention GROUP BY name, type"""
VIEW_SQL["v_relation"] = """SELECT s_name AS src, n_name AS dst, 'LOCATED_IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, n_name, 'LIVES_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'PART_OF' FROM nation JOIN region ON n_regionkey = r_regionkey"""
VIEW_SQL["v_qa"] = """SELECT q.conv_id, q.turn, q.text AS query, a.text AS response FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"""
VIEW_SQL["v_point"] = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS dense FROM embeddings"
VIEW_SQL["v_link"] = """SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS origin,
  unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""
VIEW_SQL["v_page"] = """SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"""


def v_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 5 == 0, "pending").when(F.col("doc_id") % 5 == 1, "processing").when(F.col("doc_id") % 5 == 2, "failed")
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.col("source").alias("group_id"),
        "lang",
        "text",
        status.when(F.col("doc_id") % 5 == 3, F.lit(None)).otherwise("completed").alias("status"),
    )


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def v_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_linenumber").alias("chunk_seq"),
        F.col("p_brand").alias("name"),
        F.col("p_type").alias("type"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


def v_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_entities(v_mention(spark, sf_dir))


def v_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "customer", "nation", "region"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    return (
        edge(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name", "LOCATED_IN")
        .unionByName(edge(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name", "LIVES_IN"))
        .unionByName(edge(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "PART_OF"))
    )


def v_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return q.join(a, ["conv_id", "turn"])


def v_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("dense"))


def v_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("origin"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def v_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
