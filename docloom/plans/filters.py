"""Filters, predicates and access control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import access
from docloom.plans._catalog import VIEW_SQL, query
from docloom.plans.views import v_document, v_entity, v_log, v_page, v_point
from docloom.storage import broadcast_small, read_table

VIEW_SQL["v_user"] = "SELECT c_custkey AS user_id, c_custkey % 100 = 0 AS is_admin, c_nationkey AS n FROM customer"
VIEW_SQL["v_owned"] = "SELECT o_orderkey AS document_id, o_custkey AS owner_id, o_orderkey % 25 AS group_id FROM orders"
VIEW_SQL["v_grant"] = "SELECT DISTINCT o_orderkey AS document_id, (o_custkey + 1) % (SELECT count(*) FROM customer) AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'view' ELSE 'share' END AS permission FROM orders WHERE o_orderstatus = 'P'"


def v_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % 25).alias("group_id"))


def v_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 100 == 0).alias("is_admin"), F.col("c_nationkey").alias("n"))


def v_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "customer").agg(F.count("*").alias("n_users"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "edit").when(F.col("o_orderkey") % 3 == 1, "view").otherwise("share")
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(F.broadcast(n))  # one row: a count
    return o.select(F.col("o_orderkey").alias("document_id"), ((F.col("o_custkey") + 1) % F.col("n_users")).alias("user_id"), kind.alias("permission")).distinct()


@query("SELECT id, label FROM v_point WHERE label = 3")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on payload, vectors pruned; the filter reaches the scan."""
    return read_table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"), "label")


@query("SELECT doc_id, group_id FROM v_document WHERE group_id IN ('src0', 'src7')")
def filter_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of a payload's groups is wanted."""
    d = v_document(spark, sf_dir).withColumn("group_ids", F.array("group_id"))
    return d.where(F.arrays_overlap("group_ids", F.array(F.lit("src0"), F.lit("src7")))).select("doc_id", "group_id")


@query("SELECT doc_id, filename FROM v_document WHERE status = 'completed'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: documents of one status."""
    return v_document(spark, sf_dir).where("status = 'completed'").select("doc_id", "filename")


@query("SELECT doc_id FROM v_document WHERE contains(lower(filename || ' ' || group_id || ' ' || text), 'the') AND contains(lower(filename || ' ' || group_id || ' ' || text), 'src1')")
def doc_meta_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the query occurs in the fields together."""
    fields = F.lower(F.concat_ws(" ", "filename", "group_id", "text"))
    d = v_document(spark, sf_dir).withColumn("fields", fields)
    return d.where(F.forall(F.split(F.lower(F.lit("The SRC1")), " +"), lambda w: F.instr(F.col("fields"), w) > 0)).select("doc_id")


@query("""SELECT page_id, page_id % 3 > 0 AS enabled FROM v_page WHERE page_id % 3 > 0 AND (page_id % 7 = 0 OR (page_id * 37) % 1440 >= 360)""")
def monitor_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: sources that are enabled and never checked, or last checked at least an interval ago."""
    p = v_page(spark, sf_dir).select("page_id", (F.col("page_id") % 3 > 0).alias("enabled"), F.when(F.col("page_id") % 7 != 0, (F.col("page_id") * 37) % 1440).alias("minutes_ago"))
    return p.where(F.col("enabled") & (F.col("minutes_ago").isNull() | (F.col("minutes_ago") >= 360))).select("page_id", "enabled")


@query("""SELECT doc_id, status, CASE WHEN status = 'pending' THEN 'requeue' WHEN status = 'processing' AND doc_id % 11 > 5 THEN 'pending' WHEN status = 'failed' AND doc_id % 2 = 0 THEN 'pending' ELSE 'keep' END AS action FROM v_document""")
def recover_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending is queued again, processing for over five minutes and due delays go back to pending."""
    idle = F.col("doc_id") % 11
    action = F.when(F.col("status") == "pending", "requeue").when((F.col("status") == "processing") & (idle > 5), "pending").when((F.col("status") == "failed") & (F.col("doc_id") % 2 == 0), "pending").otherwise("keep")
    return v_document(spark, sf_dir).select("doc_id", "status", action.alias("action"))


_UPLOAD = "SELECT page_id, octet_length(encode(html)) * CASE WHEN page_id % 9 = 0 THEN 0 WHEN page_id % 5 = 0 THEN 100000 ELSE 1 END AS size, 'up' || CASE WHEN page_id % 7 = 0 THEN '?' ELSE '' END || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '.txt' END AS filename FROM pages"


@query(f"""SELECT page_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 104857600 THEN 'too_large' WHEN regexp_extract(lower(filename), '([.][^.]*)$', 1) NOT IN ({", ".join(f"'{e}'" for e in T.UPLOADS)}) THEN 'extension' WHEN regexp_matches(filename, '[<>"''|?*\\\\]') THEN 'forbidden_character' ELSE 'ok' END AS verdict FROM ({_UPLOAD})""")
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each upload's verdict, by size (100 MB at most), extension and name; none stops the others."""
    n = F.col("page_id")
    size = F.octet_length("html").cast("long") * F.when(n % 9 == 0, 0).when(n % 5 == 0, 100_000).otherwise(1)
    name = F.concat(F.lit("up"), F.when(n % 7 == 0, "?").otherwise(""), n.cast("string"), F.when(n % 4 == 0, ".PDF").when(n % 4 == 1, ".docx").when(n % 4 == 2, ".exe").otherwise(".txt"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.upload_verdict(size, name).alias("verdict"))


_DANGER = " OR ".join(f"regexp_matches(html, '{p}')" for p in T.DANGEROUS)
_CLEAN = "html"
for _p in T.DANGEROUS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"


@query(f"SELECT page_id, ({_DANGER}) AS dangerous FROM pages")
def detect_dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input that holds any dangerous pattern."""
    return read_table(spark, sf_dir, "pages").select("page_id", T.dangerous(F.col("html")).alias("dangerous"))


@query(f"SELECT page_id, md5(regexp_replace({_CLEAN}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS clean_md5 FROM pages")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input with the dangerous patterns taken out one after another."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(T.sanitized(F.col("html"))).alias("clean_md5"))


@query("""SELECT c_custkey, regexp_matches(c_name, '^[a-zA-Z0-9_-]+$') AS valid_user, length(md5(c_name)) >= 32 AND regexp_matches(md5(c_name), '^[a-zA-Z0-9_-]+$') AS valid_key FROM customer""")
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User ids and API keys by pattern and length."""
    ok = "^[a-zA-Z0-9_-]+$"
    key = F.md5("c_name")
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").rlike(ok).alias("valid_user"), ((F.length(key) >= 32) & key.rlike(ok)).alias("valid_key"))


@query("SELECT d.doc_id FROM v_document d LEFT JOIN labels l USING (doc_id) WHERE d.status = 'completed' AND (l.quality IS NULL OR l.quality = 0)")
def untyped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed documents without a type."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return v_document(spark, sf_dir).where("status = 'completed'").join(lab, "doc_id", "left").where(F.col("quality").isNull() | (F.col("quality") == 0)).select("doc_id")


@query("SELECT event_id, user_id, kind FROM v_log WHERE k < 50 ORDER BY ts DESC, event_id LIMIT 100")
def unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread ones, newest first, as many as a page shows."""
    return v_log(spark, sf_dir).where("k < 50").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "kind")


@query("SELECT event_id, kind, value FROM v_log WHERE NOT ok AND user_id = 7 AND contains(kind, 'err') AND value > 1")
def log_viewer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by level, group and text, each only where it is given."""
    rows, wanted = v_log(spark, sf_dir), {"ok": F.col("ok") == F.lit(False), "user": F.col("user_id") == 7, "text": F.col("kind").contains("err"), "since": F.col("value") > 1}
    for condition in wanted.values():
        rows = rows.where(condition)
    return rows.select("event_id", "kind", "value")


@query("SELECT page_id, title FROM v_page WHERE host LIKE '%.example.com' AND contains(lower(title), 'en')")
def news_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of a source that match a search."""
    return v_page(spark, sf_dir).where(F.col("host").endswith(".example.com") & F.lower("title").contains("en")).select("page_id", "title")


def _access(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, users, memberships (every user's nation is a group of theirs) and grants."""
    users = v_user(spark, sf_dir)
    return v_owned(spark, sf_dir), users, users.select("user_id", F.col("n").cast("long").alias("group_id")), v_grant(spark, sf_dir)


@query("""SELECT user_id, 'all' AS scope, CAST(0 AS BIGINT) AS target, 'admin' AS via FROM v_user WHERE is_admin
UNION ALL SELECT user_id, 'group', CAST(n AS BIGINT), 'group' FROM v_user WHERE NOT is_admin
UNION ALL SELECT user_id, 'document', document_id, arg_min(via, rank) FROM (SELECT owner_id AS user_id, document_id, 2 AS rank, 'owner' AS via FROM v_owned WHERE owner_id IS NOT NULL UNION ALL SELECT user_id, document_id, 3, 'grant' FROM v_grant)
WHERE user_id NOT IN (SELECT user_id FROM v_user WHERE is_admin) GROUP BY user_id, document_id""")
def acl_visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sees which documents, and why, as rules: all, those of a group, or one."""
    return access.rules(*_access(spark, sf_dir))


@query("""SELECT d.document_id, CASE WHEN d.owner_id = 1 THEN 'owner' WHEN g.document_id IS NOT NULL THEN 'grant' ELSE 'group' END AS via FROM v_owned d
LEFT JOIN (SELECT DISTINCT document_id FROM v_grant WHERE user_id = 1) g USING (document_id) WHERE d.owner_id = 1 OR g.document_id IS NOT NULL OR d.group_id = (SELECT n FROM v_user WHERE user_id = 1)""")
def acl_user_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object rule expanded for one user: own, granted and of a shared group."""
    return access.visible_to(1, *_access(spark, sf_dir))


@query("""SELECT asked, document_id FROM (VALUES (1), (2), (-1)) a(asked), v_owned d WHERE coalesce((SELECT bool_or(is_admin) FROM v_user WHERE user_id = asked), FALSE)
OR NOT EXISTS (SELECT 1 FROM v_user WHERE user_id = asked) OR d.group_id IN (SELECT n FROM v_user WHERE user_id = asked)""")
def acl_search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches of three users may return: groups that overlap only, and everything for a user without groups."""
    d, users, membership, _ = _access(spark, sf_dir)
    parts = [access.search_filter(u, d, users, membership).select(F.lit(u).alias("asked"), "document_id") for u in (1, 2, -1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT document_id, group_id FROM v_owned WHERE group_id IS NULL OR group_id IN (SELECT n FROM v_user WHERE user_id = 1)")
def acl_list_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In lists, a document without a group is public; else a group must be the user's."""
    mine = v_user(spark, sf_dir).where("user_id = 1").select(F.col("n").cast("long").alias("group_id")).distinct()
    d = v_owned(spark, sf_dir)
    return d.where(F.col("group_id").isNull()).unionByName(d.join(broadcast_small(mine), "group_id", "left_semi")).select("document_id", "group_id")


@query("""SELECT DISTINCT user_id, document_id FROM (SELECT owner_id AS user_id, document_id FROM v_owned UNION ALL SELECT user_id, document_id FROM v_grant WHERE permission = 'edit')""")
def acl_editable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editing takes ownership or an explicit grant; groups don't help."""
    own = v_owned(spark, sf_dir).select(F.col("owner_id").alias("user_id"), "document_id")
    return own.unionByName(v_grant(spark, sf_dir).where("permission = 'edit'").select("user_id", "document_id")).distinct()


@query("""WITH asked AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' WHEN 2 THEN 'admin' WHEN 3 THEN 'auditor' ELSE 'owner' END AS role,
CASE c_custkey % 3 WHEN 0 THEN '/documents/' || c_custkey WHEN 1 THEN '/search' ELSE '/xsearch' END AS resource, CASE c_custkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method FROM customer)
SELECT *, CASE role WHEN 'viewer' THEN method = 'GET' AND resource <> '/xsearch' WHEN 'editor' THEN (method = 'GET' AND resource <> '/xsearch') OR (method = 'POST' AND starts_with(resource, '/documents/'))
WHEN 'auditor' THEN FALSE ELSE TRUE END AS allowed FROM asked""")
def rbac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role's policies, and those of the roles that it inherits, through any number of others, against each request.

    Owners inherit admins, these editors, these viewers; auditors inherit each other in a circle and may do nothing.
    """
    c = F.col("c_custkey")
    requests = read_table(spark, sf_dir, "customer").select(
        c.alias("user_id"), F.when(c % 5 == 0, "viewer").when(c % 5 == 1, "editor").when(c % 5 == 2, "admin").when(c % 5 == 3, "auditor").otherwise("owner").alias("role"),
        F.when(c % 3 == 0, F.concat(F.lit("/documents/"), c.cast("string"))).when(c % 3 == 1, "/search").otherwise("/xsearch").alias("resource"), F.when(c % 2 == 0, "GET").otherwise("POST").alias("method"),
    )
    policies = spark.createDataFrame(access.POLICIES, "role string, glob string, method string")
    circle = [("auditor", "reviewer"), ("reviewer", "auditor")]
    inherits = spark.createDataFrame([*access.INHERITS, ("owner", "admin"), *circle], "role string, parent string")
    return access.enforce(requests, policies, inherits).select("user_id", "role", "resource", "method", "allowed")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 20")
def min_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts long enough to work on."""
    return read_table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 20).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def kv_category_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category of a key-value table; the filter reaches the scan."""
    return read_table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", "p_name")


@query("SELECT id, label FROM v_point WHERE label IN (1, 2) ORDER BY id LIMIT 50 OFFSET 20")
def chunk_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of points, without vectors, in a fixed order."""
    return v_point(spark, sf_dir).where("label IN (1, 2)").orderBy("id").offset(20).limit(50).select("id", "label")


@query("SELECT id, label, round(list_sum(dense), 6) AS total FROM v_point WHERE id IN (3, 30, 300)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by id, with their vectors."""
    total = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x)
    return v_point(spark, sf_dir).where(F.col("id").isin(3, 30, 300)).select("id", "label", F.round(total, 6).alias("total"))


@query("SELECT name, type, confidence FROM v_entity WHERE contains(name, '#1') ORDER BY confidence DESC, name, type LIMIT 20")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose name holds a text, surest first."""
    return v_entity(spark, sf_dir).where(F.col("name").contains("#1")).orderBy(F.desc("confidence"), "name", "type").limit(20).select("name", "type", "confidence")
