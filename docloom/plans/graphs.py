"""Joins and graph operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph, latest
from docloom.plans._catalog import VIEW_SQL, query
from docloom.plans.views import v_document, v_entity, v_log, v_mention, v_point, v_relation
from docloom.storage import dealt, read_table

VIEW_SQL["v_named"] = "SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN ' ' ELSE '' END || CASE c_custkey % 3 WHEN 0 THEN 'ENTITY ' ELSE 'Entity ' END || (c_custkey % 40) AS name, c_mktsegment AS type, round(c_acctbal / 10000, 4) AS confidence FROM customer"


def v_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    name = F.concat(F.when(c % 2 == 0, " ").otherwise(""), F.when(c % 3 == 0, "ENTITY ").otherwise("Entity "), (c % 40).cast("string"))
    return read_table(spark, sf_dir, "customer").select(c.alias("id"), name.alias("name"), F.col("c_mktsegment").alias("type"), F.round(F.col("c_acctbal") / 10000, 4).alias("confidence"))


@query("""SELECT o.o_orderkey AS doc_id, o.o_orderstatus AS status, c.l_linenumber AS chunk_seq, p.p_brand AS name, p.p_type AS type, count(*) AS n
FROM orders o JOIN lineitem c ON c.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = c.l_partkey GROUP BY ALL""")
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by document and chunk: documents to their chunks, chunks to what they mention."""
    d = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    has_chunk = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_seq"), F.col("l_partkey").alias("p_partkey"))
    mentions = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_type").alias("type"))
    n = has_chunk.count()
    named = dealt(has_chunk.join(mentions, "p_partkey").drop("p_partkey"), n, "doc_id")  # entities by document are grouped where documents are joined
    return dealt(d, n, "doc_id").join(named, "doc_id").groupBy("doc_id", "status", "chunk_seq", "name", "type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT doc_id, name, type FROM v_mention) SELECT a.name AS name_a, a.type AS type_a, b.name AS name_b, b.type AS type_b, count(*) AS n_docs
FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.type < b.type GROUP BY ALL""")
def colink_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of different types that documents mention together."""
    return graph.colinks(v_mention(spark, sf_dir), read_table(spark, sf_dir, "lineitem").count())


_KEEP = "SELECT id, first_value(id) OVER (PARTITION BY lower(trim(name)), type ORDER BY confidence DESC, id) AS keeper FROM v_named"


@query(_KEEP)
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by normalised name and type, and who stays."""
    return graph.keepers(v_named(spark, sf_dir))


@query(f"""WITH k AS ({_KEEP}), e AS (SELECT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS dst FROM orders)
SELECT DISTINCT a.keeper AS src, b.keeper AS dst FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst WHERE a.keeper <> b.keeper""")
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges moved to the entities that stay."""
    n = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    e = read_table(spark, sf_dir, "orders").join(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % F.col("n")).alias("dst"))  # one row: a count
    return graph.remap(e, graph.keepers(v_named(spark, sf_dir)))


@query("""SELECT e.type, count(*) AS entities, count_if(length(e.name) < 8) AS short_names, count_if(e.confidence < 0.95) AS unsure, count_if(r.n IS NULL) AS orphans,
greatest(0, 100 - 15 * (CAST(count_if(length(e.name) < 8) > 0 AS INTEGER) + CAST(count_if(e.confidence < 0.95) > 0 AS INTEGER) + CAST(count_if(r.n IS NULL) > 0 AS INTEGER))) AS score
FROM v_entity e LEFT JOIN (SELECT p_brand AS name, count(*) AS n FROM part WHERE p_size > 49 GROUP BY p_brand) r USING (name) GROUP BY e.type""")
def validate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings on names, confidence and missing domain edges; a score from their number."""
    edges = read_table(spark, sf_dir, "part").where("p_size > 49").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    short, unsure, alone = F.count_if(F.length("name") < 8), F.count_if(F.col("confidence") < 0.95), F.count_if(F.col("n").isNull())
    warnings = (short > 0).cast("int") + (unsure > 0).cast("int") + (alone > 0).cast("int")
    return v_entity(spark, sf_dir).join(edges, "name", "left").groupBy("type").agg(F.count("*").alias("entities"), short.alias("short_names"), unsure.alias("unsure"), alone.alias("orphans"), F.greatest(F.lit(0), 100 - 15 * warnings).alias("score"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that nothing mentions."""
    used = read_table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose file is gone."""
    return read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, file_hash, min(doc_id) OVER (PARTITION BY file_hash) AS first_id, count(*) OVER (PARTITION BY file_hash) AS copies FROM v_document QUALIFY copies > 1")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content hash occurs more than once, with the first of them.

    Hashes are counted with a map-side sum, so a hash that a third of all rows share doesn't meet in one task.
    """
    d = v_document(spark, sf_dir).select("doc_id", "file_hash")
    many = d.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return latest.look_up(d, many, ["file_hash"], "doc_id").select("doc_id", "file_hash", "first_id", "copies")


@query("SELECT o_orderkey, coalesce(c_name, 'unknown') AS username FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def uploader_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who uploaded, by name where it is known."""
    c = read_table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return read_table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("username"))


@query("""SELECT c_custkey AS source, count(event_id) AS downloads, CAST(coalesce(sum(k), 0) AS BIGINT) AS items, coalesce(count_if(NOT ok), 0) AS errors FROM customer LEFT JOIN v_log ON user_id = c_custkey GROUP BY c_custkey""")
def monitor_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads of each source; sources without any keep 0. Logs are summed before the join."""
    sums = v_log(spark, sf_dir).groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("downloads"), F.sum("k").alias("items"), F.count_if(~F.col("ok")).alias("errors"))
    s = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(sums, "source", "left").select("source", zero("downloads"), zero("items"), zero("errors"))


@query("""SELECT p_type AS function, coalesce(min(s_name) FILTER (WHERE s_suppkey % 10 = length(p_type)), (SELECT min(s_name) FROM supplier WHERE s_acctbal > 0)) AS provider
FROM (SELECT DISTINCT p_type FROM part), supplier GROUP BY p_type""")
def provider_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function's provider, else the first that is enabled."""
    f = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("function")).distinct().withColumn("slot", F.length("function").cast("long"))
    s = read_table(spark, sf_dir, "supplier")
    named = s.groupBy((F.col("s_suppkey") % 10).alias("slot")).agg(F.min("s_name").alias("mapped"))
    first = s.where("s_acctbal > 0").agg(F.min("s_name").alias("fallback"))
    return f.join(named, "slot", "left").join(F.broadcast(first)).select("function", F.coalesce("mapped", "fallback").alias("provider"))  # fallback: one row


@query("""SELECT DISTINCT a.name AS src, a.type AS src_type, b.name AS dst, b.type AS dst_type FROM (SELECT DISTINCT p_brand AS x, 'Brand#' || (p_size % 25) AS y FROM part) r JOIN v_entity a ON a.name = r.x JOIN v_entity b ON b.name = r.y""")
def relation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations name their ends only; each matches every entity of that name."""
    r = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25).cast("string")).alias("dst")).distinct()
    e = v_entity(spark, sf_dir)
    a, b = e.select(F.col("name").alias("src"), F.col("type").alias("src_type")), e.select(F.col("name").alias("dst"), F.col("type").alias("dst_type"))
    return r.join(a, "src").join(b, "dst").select("src", "src_type", "dst", "dst_type").distinct()


@query("SELECT d.doc_id, l.doc_id AS label_doc, l.quality FROM v_document d JOIN labels l ON starts_with(d.file_hash, substr(sha256((SELECT text FROM documents x WHERE x.doc_id = l.doc_id)), 1, 8)) WHERE l.toxic = 1")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results matched by the first eight characters of an id: an equi-join on the prefix, then the check."""
    d = v_document(spark, sf_dir).select("doc_id", "file_hash")
    marked = read_table(spark, sf_dir, "labels").where("toxic = 1").join(d, "doc_id").select(F.col("doc_id").alias("label_doc"), "quality", F.substring("file_hash", 1, 8).alias("prefix"))
    return d.withColumn("prefix", F.substring("file_hash", 1, 8)).join(marked, "prefix").where(F.startswith("file_hash", "prefix")).select("doc_id", "label_doc", "quality")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'start' WHEN a.doc_id IS NULL THEN 'stop' ELSE 'keep' END AS action FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def folder_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What should be watched against what is: start, stop or keep."""
    a = read_table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.lit(True).alias("wanted"))
    b = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("running"))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("running").isNull(), "start").when(F.col("wanted").isNull(), "stop").otherwise("keep").alias("action"))


@query("""SELECT doc_id, chunk_id, count(DISTINCT (name, type)) AS entity_count FROM v_mention WHERE contains(name, '#1') OR contains(name, '#2') GROUP BY doc_id, chunk_id ORDER BY entity_count DESC, doc_id, chunk_id LIMIT 20""")
def graph_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with most entities that match any term."""
    m = v_mention(spark, sf_dir).where(F.col("name").contains("#1") | F.col("name").contains("#2"))
    return m.groupBy("doc_id", "chunk_id").agg(F.countDistinct("name", "type").alias("entity_count")).orderBy(F.desc("entity_count"), "doc_id", "chunk_id").limit(20)


@query("SELECT name, type, confidence, n_docs, n_mentions FROM v_entity")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged from mentions."""
    return graph.merge_entities(v_mention(spark, sf_dir))


@query("SELECT chunk_id, min(doc_id) AS doc_id, max(chunk_seq) AS chunk_seq FROM v_mention GROUP BY chunk_id")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: chunk nodes merged by id."""
    return v_mention(spark, sf_dir).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.max("chunk_seq").alias("chunk_seq"))


@query("SELECT name, type FROM v_entity WHERE starts_with(lower(name), 'brand#2') OR levenshtein(lower(name), 'brand#9') <= 1")
def entity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with the text or are within a typing error of it."""
    n = F.lower("name")
    return v_entity(spark, sf_dir).where(n.startswith("brand#2") | (F.levenshtein(n, F.lit("brand#9")) <= 1)).select("name", "type")


_PATHS = """e AS MATERIALIZED (SELECT src, dst FROM v_relation WHERE src <> dst UNION SELECT dst, src FROM v_relation WHERE src <> dst),
start AS (SELECT DISTINCT src AS start FROM v_relation WHERE src LIKE 'Supplier%'),
one AS MATERIALIZED (SELECT start, [start, dst] AS path FROM start JOIN e ON src = start QUALIFY row_number() OVER (PARTITION BY start ORDER BY dst) <= 50),
two AS MATERIALIZED (SELECT start, list_append(path, dst) AS path FROM one JOIN e ON src = path[2] JOIN (SELECT start, count(*) AS n FROM one GROUP BY start) USING (start) WHERE NOT list_contains(path, dst) QUALIFY row_number() OVER (PARTITION BY start ORDER BY path, dst) <= 50 - n),
paths AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT * FROM two)"""


def _suppliers(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("src").startswith("Supplier")).select(F.col("src").alias("node")).distinct()


@query("""WITH RECURSIVE e AS (SELECT src, dst FROM v_relation UNION SELECT dst, src FROM v_relation),
walk(start, node, hops) AS (SELECT DISTINCT src, src, 0 FROM v_relation WHERE src LIKE 'Supplier%' UNION SELECT w.start, e.dst, w.hops + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hops < 2)
SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY start, node""")
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes within two hops of each supplier."""
    r = v_relation(spark, sf_dir)
    return graph.neighbourhood(r, _suppliers(r), 2)


@query(f"""WITH {_PATHS}, walked AS (SELECT start, unnest(path[:-2]) AS a, unnest(path[2:]) AS b FROM paths)
SELECT DISTINCT start, src, dst, type FROM walked JOIN v_relation ON src = a AND dst = b OR src = b AND dst = a""")
def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of those paths, as they are directed."""
    r = v_relation(spark, sf_dir)
    return graph.path_edges(graph.paths(r, _suppliers(r), 2, 50), r)


@query("SELECT name, type, round(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS BIGINT) / (100.0 * count(*)), 6) AS confidence, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM v_mention WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY name, type")
def graph_delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without some documents."""
    gone = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return graph.delete_document(v_mention(spark, sf_dir), gone, read_table(spark, sf_dir, "lineitem").count())


@query("SELECT p_type AS preset, p_brand AS kind, count(*) AS n_keys, count(DISTINCT p_size) AS n_sizes FROM part GROUP BY ALL")
def schema_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets with the number of their keys by kind."""
    return read_table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("preset"), F.col("p_brand").alias("kind")).agg(F.count("*").alias("n_keys"), F.countDistinct("p_size").alias("n_sizes"))


@query("""SELECT name, type, CASE WHEN length(name) < 8 THEN 'short_name' ELSE 'unknown_type' END AS warning FROM v_entity WHERE length(name) < 8 OR type NOT IN (SELECT p_type FROM part WHERE p_size = 50)""")
def validate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names and types that the schema doesn't have."""
    known = read_table(spark, sf_dir, "part").where("p_size = 50").select("p_type").distinct().withColumn("in_schema", F.lit(True))
    e = v_entity(spark, sf_dir).join(known, F.col("type") == F.col("p_type"), "left")
    short = F.length("name") < 8
    return e.where(short | F.col("in_schema").isNull()).select("name", "type", F.when(short, "short_name").otherwise("unknown_type").alias("warning"))


@query(r"""SELECT doc_id, kind, value, count(*) AS n FROM (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}')) AS value FROM documents
UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{4,}')) FROM documents UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) FROM documents) GROUP BY ALL""")
def extract_entities_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic extractor: entities by pattern."""
    patterns = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "number": "[0-9]{4,}", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}"}

    def found_by(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [found_by(k, p) for k, p in patterns.items()]
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.concat(*found)).alias("e"))
    return d.groupBy("doc_id", F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


@query("""SELECT p.id, p.label, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS doc_type, l.quality IS NOT NULL AS updated FROM v_point p LEFT JOIN labels l ON l.doc_id = p.id""")
def doc_type_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: documents' types put on their points: a join that updates; other points keep the type they have."""
    found = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("new_type"))
    p = v_point(spark, sf_dir).select("id", "label", F.lit("unknown").alias("doc_type")).join(found, "id", "left")
    return p.select("id", "label", F.coalesce("new_type", "doc_type").alias("doc_type"), F.col("new_type").isNotNull().alias("updated"))


@query("""SELECT name, type, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs, max(rebuilt) AS rebuilt FROM (SELECT name, type, doc_id, FALSE AS rebuilt FROM v_mention WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT name, type, doc_id, TRUE FROM v_mention WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND chunk_seq <= 2) GROUP BY name, type""")
def graph_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents' part of the graph cleared and extracted anew from their first chunks; running it again
    changes nothing."""
    again = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return graph.rebuild(v_mention(spark, sf_dir), v_mention(spark, sf_dir), again, 2)


@query("""WITH k AS (SELECT id, min(id) OVER (PARTITION BY lower(trim(name)), type) AS keeper FROM v_named), e AS (SELECT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS dst, 'KNOWS' AS type FROM orders)
SELECT DISTINCT coalesce(a.keeper, src) AS src, coalesce(b.keeper, dst) AS dst, CASE WHEN b.keeper <> dst THEN 'MENTIONS' WHEN a.keeper <> src THEN 'RELATED_TO' ELSE type END AS type
FROM e LEFT JOIN k a ON a.id = src LEFT JOIN k b ON b.id = dst WHERE coalesce(a.keeper, src) <> coalesce(b.keeper, dst)""")
def entity_merge_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged into the one of least id; edges into a merged entity become MENTIONS, edges out RELATED_TO."""
    n = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    e = read_table(spark, sf_dir, "orders").join(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % F.col("n")).alias("dst"), F.lit("KNOWS").alias("type"))  # one row: a count
    return graph.merge_into_lowest(e, v_named(spark, sf_dir))
