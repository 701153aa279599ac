"""Sources, parsing and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.plans._catalog import query
from docloom.plans.views import v_document, v_link, v_log, v_page
from docloom.sources.web import since_last_check
from docloom.storage import read_table

_STRIP = r"regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


@query(f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph_index, CAST(length(p[i]) AS INTEGER) AS char_count, md5(p[i]) AS content_md5
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS p FROM documents))""")
def parse_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of plain text, with index and length."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_index", "p")).select("doc_id", "paragraph_index", F.length("p").alias("char_count"), F.md5("p").alias("content_md5"))


@query("""SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_mktsegment: ' || c_mktsegment AS row_text FROM customer""")
def csv_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a table's rows as "header: value" text."""
    return read_table(spark, sf_dir, "customer").select("c_custkey", T.pair_text(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("row_text"))


@query("""SELECT doc_id, n < 50 OR marks > 0 AS needs_ocr
FROM (SELECT doc_id, length(trim(text)) AS n, len(regexp_extract_all(text, '[�¤]')) AS marks FROM documents)""")
def needs_ocr_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of under fifty characters, and garbled ones, need recognition."""
    t = F.trim("text")
    flag = (F.length(t) < 50) | F.col("text").rlike("[�¤]")
    return read_table(spark, sf_dir, "documents").select("doc_id", flag.alias("needs_ocr"))


@query("""SELECT r_regionkey, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a Markdown table with header and rule."""
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |")))
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.concat(F.lit("| key | nation |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("markdown"))


@query("""SELECT conv_id, string_agg('## Page ' || (turn + 1) || chr(10) || chr(10) || CASE role WHEN 'system' THEN '> ' || text WHEN 'user' THEN '### ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown
FROM conversations GROUP BY conv_id""")
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's pages as Markdown, by layout type."""
    c = read_table(spark, sf_dir, "conversations")
    body = lambda x: F.when(x["role"] == "system", F.concat(F.lit("> "), x["text"])).when(x["role"] == "user", F.concat(F.lit("### "), x["text"])).otherwise(x["text"])
    page = lambda x: F.concat(F.lit("## Page "), (x["turn"] + 1).cast("string"), F.lit("\n\n"), body(x))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), page), "\n\n").alias("markdown"))


@query("SELECT page_id, title, host FROM v_page")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page title and host."""
    return v_page(spark, sf_dir).select("page_id", "title", "host")


@query("SELECT page_id, href, count(*) AS n FROM v_link GROUP BY page_id, href")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page with how often each occurs."""
    return v_link(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN href LIKE '/%' THEN origin || href ELSE origin || '/' || href END AS link,
sha256(href) AS link_hash FROM v_link""")
def scrape_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links made absolute against the page's origin."""
    href = F.col("href")
    link = F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat("origin", href)).otherwise(F.concat("origin", F.lit("/"), href))
    return v_link(spark, sf_dir).select("page_id", link.alias("link"), F.sha2("href", 256).alias("link_hash")).distinct()


@query("""SELECT DISTINCT page_id, href, (regexp_matches(lower(href), '[.](pdf|docx?|xlsx?|rtf|txt|csv)([?#]|$)') OR regexp_matches(lower(href), '/(download|files?|docs?|attachments?|upload)/')
OR (contains(href, '?') AND regexp_matches(lower(href), '(download|file|doc)='))) AS is_document FROM v_link""")
def is_document_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a link points at a document: by suffix, by path, by query."""
    h = F.lower("href")
    flag = h.rlike("[.](pdf|docx?|xlsx?|rtf|txt|csv)([?#]|$)") | h.rlike("/(download|files?|docs?|attachments?|upload)/") | (F.col("href").contains("?") & h.rlike("(download|file|doc)="))
    return v_link(spark, sf_dir).select("page_id", "href", flag.alias("is_document")).distinct()


@query("""SELECT page_id, CASE WHEN contains(lower(title), 'order') THEN 'order' WHEN contains(lower(title), 'law') THEN 'law' ELSE 'other' END AS doc_type,
regexp_extract(url, '([0-9]+)', 1) AS number, length(title) > 30 AS long_title FROM v_page""")
def link_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by keyword, number by pattern, whether the title is descriptive."""
    t = F.lower("title")
    return v_page(spark, sf_dir).select("page_id", F.when(t.contains("order"), "order").when(t.contains("law"), "law").otherwise("other").alias("doc_type"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"), (F.length("title") > 30).alias("long_title"))


@query(r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 500), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), 1, 300) AS preview FROM pages""")
def page_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page's beginning as plain text."""
    return read_table(spark, sf_dir, "pages").select("page_id", T.page_preview(F.col("html")).alias("preview"))


@query("""SELECT page_id, title, CAST(k.d AS INTEGER) AS age_days FROM (SELECT *, page_id % 60 AS d FROM v_page) k
WHERE k.d <= 23 AND (contains(lower(title), 'th') OR contains(lower(title), 'en'))""")
def rss_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items within the look-back whose title has any keyword (no keywords: all pass)."""
    from docloom.sources.web import feed_items

    items = v_page(spark, sf_dir).select("page_id", "title", (F.col("page_id") % 60).cast("int").alias("age_days"))
    return feed_items(items, ["th", "EN"], 23)


@query("""SELECT event_id FROM v_log LEFT JOIN (SELECT user_id, max(ts) AS last_check FROM v_log WHERE kind = 'view' AND user_id % 3 > 0 GROUP BY user_id) USING (user_id) WHERE ts >= last_check - INTERVAL 3 DAY""")
def feed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items no older than the look-back (three days here) before their source's last check; sources that were never
    checked take those of the last days, which these tables don't have."""
    log = v_log(spark, sf_dir)
    checks = log.where("kind = 'view' AND user_id % 3 > 0").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last_check"))
    return since_last_check(log.select(F.col("user_id").alias("source"), F.col("ts").alias("published"), "event_id"), checks, 3).select("event_id")


@query("SELECT doc_id, file_hash, 'emb:' || substr(file_hash, 1, 16) AS cache_key, substr(md5(text), 1, 12) AS short_id, substr(md5(text), 1, 16) AS long_id FROM v_document")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content hash, cache key and short ids."""
    return v_document(spark, sf_dir).select("doc_id", "file_hash", F.concat(F.lit("emb:"), F.substring("file_hash", 1, 16)).alias("cache_key"), F.substring(F.md5("text"), 1, 12).alias("short_id"), F.substring(F.md5("text"), 1, 16).alias("long_id"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr(h, 17, 2) AS BIGINT) & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '-0')) AS h FROM documents)""")
def point_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deterministic point ids."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).alias("point_id"))


@query("""SELECT doc_id, substr(text, 1, 500) AS preview, substr(text, 1, 200) AS name_cap, least(1.0, greatest(0.0, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 13) / 10.0 END, 0.7))) AS confidence,
replace(replace('has ' || source || '`s', '`', ''), ' ', '_') AS relation FROM documents""")
def caps_and_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped texts, clamped confidence, safe relation names."""
    given = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise((F.col("doc_id") % 13) / 10.0)
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 1, 500).alias("preview"), F.substring("text", 1, 200).alias("name_cap"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(given, F.lit(0.7)))).alias("confidence"),
        F.translate(F.concat(F.lit("has "), "source", F.lit("`s")), " `", "_").alias("relation"),
    )


@query(f"SELECT page_id, lower(substr({_STRIP.format('title')}, 1, 80)) || '|' || '2024-01-01' AS news_key FROM v_page")
def news_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the key under which a news item is known."""
    return v_page(spark, sf_dir).select("page_id", T.news_key(F.col("title"), F.lit("2024-01-01T00:00:00")).alias("news_key"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-ZА-ЯЁ]{2,}|[A-Za-z]{3,}|[а-яё]{4,}'))), ',') AS terms FROM benchmark")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms of a question, sorted."""
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(T.query_terms(F.col("text")))), ",").alias("terms"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'has_date' END, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'has_amounts' END,
CASE WHEN contains(text, 'igned') THEN 'signed' END, CASE WHEN contains(text, '@') THEN 'has_contact' END, CASE WHEN length(text) > 3000 THEN 'multi_page' END) AS tags FROM documents""")
def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tags by pattern."""
    t = F.col("text")
    tags = [(t.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "has_date"), (t.rlike("[0-9]{4,}"), "has_amounts"), (t.contains("igned"), "signed"), (t.contains("@"), "has_contact"), (F.length(t) > 3000, "multi_page")]
    return read_table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", *[F.when(c, n) for c, n in tags]).alias("tags"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) AS base_name, regexp_extract(url, '^([a-z]+):', 1) AS scheme, host, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM v_page")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts of a URL."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    return v_page(spark, sf_dir).select("page_id", F.regexp_extract(bare, "([^/]*)/?$", 1).alias("base_name"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), "host", F.regexp_extract("url", "[?]([^#]*)", 1).alias("query"))


@query("""SELECT event_id, CAST(json_extract_string(regexp_extract(replace(replace('```json ' || props || ' ``` done', '```json', ''), '```', ''), '(?s)([{].*[}])', 1), '$.k') AS BIGINT) AS k,
props AS round_trip FROM events""")
def parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object inside a fenced answer, and writing it back."""
    answer = F.concat(F.lit("```json "), "props", F.lit(" ``` done"))
    parsed = F.from_json(T.json_object(answer), "k long")
    e = read_table(spark, sf_dir, "events").select("event_id", parsed.alias("j"))
    return e.select("event_id", F.col("j.k").alias("k"), F.regexp_replace(F.to_json("j"), ":", ": ").alias("round_trip"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(the|der|la)') THEN 'search' END, CASE WHEN regexp_matches(lower(text), '(tion|ung)') THEN 'analyse' END,
CASE WHEN contains(lower(text), 'ing') THEN 'generate' END) AS intents, CASE WHEN length(text) > 300 THEN 'complex' WHEN length(text) > 80 THEN 'medium' ELSE 'simple' END AS complexity FROM conversations WHERE role = 'user'""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task types by keywords, and a complexity bucket."""
    t = F.lower("text")
    kinds = F.concat_ws(",", F.when(t.rlike("(the|der|la)"), "search"), F.when(t.rlike("(tion|ung)"), "analyse"), F.when(t.contains("ing"), "generate"))
    n = F.length("text")
    return read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", kinds.alias("intents"), F.when(n > 300, "complex").when(n > 80, "medium").otherwise("simple").alias("complexity"))


@query("SELECT user_id, CAST(attempt AS INTEGER) AS attempt, 1.0 * pow(2, attempt) AS delay FROM (SELECT DISTINCT user_id FROM events), LATERAL (SELECT unnest(range(0, 5)) AS attempt)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry delays of each client, doubling."""
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt")).withColumn("delay", F.pow(F.lit(2.0), "attempt"))


@query("""SELECT c_custkey, c_name AS plain, 12 + octet_length(encode(c_name)) + 16 AS sealed_bytes, c_custkey % 2 = 0 AS opens_with_other_key, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS other_plain FROM customer""")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """authenticated encryption and back, by a key of the caller's; a text sealed with another key doesn't open.

    Each row's key is made of the caller's and, for odd rows, another one; all are opened by the caller's as well.
    """
    key, other = F.sha2(F.lit("a key for tests"), 256), F.sha2(F.lit("another one"), 256)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.substring(key, 1, 32).alias("key"), F.substring(F.when(F.col("c_custkey") % 2 == 0, key).otherwise(other), 1, 32).alias("own"))
    s = c.select("c_custkey", "key", "own", T.sealed(F.col("c_name"), F.col("own")).alias("sealed"))
    opened, tried = T.opened(F.col("sealed"), F.col("own")), T.opened(F.col("sealed"), F.col("key"))
    return s.select("c_custkey", opened.alias("plain"), F.octet_length(F.unbase64("sealed")).alias("sealed_bytes"), tried.isNotNull().alias("opens_with_other_key"), tried.alias("other_plain"))


_ASIDE_SQL = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _tag in T.ASIDE:
    _ASIDE_SQL = f"regexp_replace({_ASIDE_SQL}, '<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'gsi')"
_INNER_SQL = ", ".join(f"nullif(regexp_extract(c, '<{t}\\b[^>]*>(.*)</{t}>', 1, 'si'), '')" for t in ("article", "main", "body"))


@query(f"""SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce({_INNER_SQL}, c), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS t FROM (SELECT page_id, {_ASIDE_SQL} AS c FROM pages))""")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    t = read_table(spark, sf_dir, "pages").select("page_id", T.main_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '<meta[^>]*charset="([^"]*)"', 1), '') AS charset, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings, len(regexp_extract_all(html, '<link[^>]*type="application/(?:rss|atom)[+]xml"')) AS feeds, contains(html, 'sitemap') AS has_sitemap FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says of itself: language, character set, headings, feeds, a site map."""
    one = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    many = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return read_table(spark, sf_dir, "pages").select(
        "page_id", one('<html[^>]*\\blang="([^"]*)"').alias("lang"), one('<meta[^>]*charset="([^"]*)"').alias("charset"), many("<h[1-6][ >]").alias("headings"),
        many('<link[^>]*type="application/(?:rss|atom)[+]xml"').alias("feeds"), F.col("html").contains("sitemap").alias("has_sitemap"),
    )


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def regional_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the regional digest's stand-in."""
    return read_table(spark, sf_dir, "documents").select("doc_id", T.regional_hash(F.col("text")).alias("digest"))
