"""Chunks, vectors, ranking and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import query_terms, strip
from docloom.operators import chunking, classify, graph, latest
from docloom.operators import retrieval as R
from docloom.operators.substrings import SubstringIndex
from docloom.plans._catalog import VIEW_SQL, query
from docloom.plans.views import v_document, v_mention, v_point
from docloom.storage import broadcast_small, read_table, stage

SIZE, OVERLAP = 1000, 200
_END = f"CASE WHEN s + {SIZE} < n AND r > 0 AND {SIZE} - r >= {SIZE // 2} THEN s + {SIZE} - r + 1 ELSE s + {SIZE} END"
VIEW_SQL["v_chunk"] = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1 AS INTEGER) AS chunk_index, start_pos, end_pos, content FROM (
  WITH RECURSIVE cut(doc_id, n, start_pos, end_pos, text) AS (
    SELECT doc_id, n, s, {_END}, text FROM (SELECT doc_id, length(text) AS n, 0 AS s, strpos(reverse(substr(text, 1, {SIZE})), ' ') AS r, text FROM documents WHERE length(text) > 0)
    UNION ALL SELECT doc_id, n, s, {_END}, text
      FROM (SELECT doc_id, n, end_pos - {OVERLAP} AS s, strpos(reverse(substr(text, end_pos - {OVERLAP} + 1, {SIZE})), ' ') AS r, text FROM cut WHERE end_pos - {OVERLAP} < n))
  SELECT doc_id, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos, regexp_replace(substr(text, start_pos + 1, end_pos - start_pos), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS content FROM cut) WHERE content <> ''"""
_COS = "CASE WHEN list_dot_product(p.dense, p.dense) = 0 THEN 0.0 ELSE round(list_dot_product(p.dense, q.dense) / (sqrt(list_dot_product(p.dense, p.dense)) * sqrt(list_dot_product(q.dense, q.dense))), 6) END"
_BM25 = r"""d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents),
tf AS MATERIALIZED (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
idf0 AS MATERIALIZED (SELECT word, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, corpus GROUP BY word, n),
idf AS MATERIALIZED (SELECT word, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT item_id AS query_id, word, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS word FROM benchmark) GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, tf.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))), 6) AS score FROM q JOIN idf USING (word) JOIN tf USING (word) JOIN d USING (doc_id), corpus GROUP BY query_id, tf.doc_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def v_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(read_table(spark, sf_dir, "documents"), "fixed", SIZE, OVERLAP)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id: one row."""
    return list(v_point(spark, sf_dir).orderBy("id").select("dense").first()[0])


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    questions = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_topk(read_table(spark, sf_dir, "documents").select("doc_id", "text"), questions, k)


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Documents by vector for each question; a question's vector is that of its number."""
    p = v_point(spark, sf_dir)
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(p, F.col("id") == F.col("query_id")).select("query_id", "dense")
    return R.vector_topk_each(p, asked, k)


@query("SELECT doc_id, chunk_index, start_pos, end_pos, md5(content) AS content_md5 FROM v_chunk")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows that end at spaces."""
    return v_chunk(spark, sf_dir).select("doc_id", "chunk_index", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive separators; tests hold chunks to their invariants."""
    return chunking.chunk(read_table(spark, sf_dir, "documents"), "recursive", SIZE, OVERLAP)


@query("SELECT doc_id, doc_id || '_chunk_' || lpad(CAST(chunk_index + 1 AS VARCHAR), 5, '0') AS chunk_id, chunk_index + 1 AS chunk_seq, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM v_chunk")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence, total and an id that names the document."""
    return chunking.numbered(v_chunk(spark, sf_dir).drop("content")).select("doc_id", "chunk_id", "chunk_seq", "total_chunks")


@query("SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_chunk GROUP BY doc_id")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and characters of each document."""
    return v_chunk(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("SELECT doc_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5 FROM v_chunk GROUP BY doc_id")
def reassemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text from its chunks in order."""
    seq = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return v_chunk(spark, sf_dir).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(seq, lambda x: x["content"]), "\n\n")).alias("text_md5"))


@query("SELECT doc_id, chunk_index, content_md5 FROM (SELECT doc_id, chunk_index, md5(content) AS content_md5, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY length(content) DESC, doc_id, chunk_index) AS place FROM v_chunk) WHERE place = 1")
def dedup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: of chunks that begin with the same 100 characters, the longest."""
    c = v_chunk(spark, sf_dir)
    return latest.first_per(c, [F.substring("content", 1, 100)], [F.desc(F.length("content")), F.col("doc_id"), F.col("chunk_index")]).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, chunk_index, substr(content, 1, 600) AS head FROM v_chunk WHERE chunk_index < 2")
def first_n_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What typing looks at: the first two chunks, 600 characters of each."""
    return v_chunk(spark, sf_dir).where("chunk_index < 2").select("doc_id", "chunk_index", F.substring("content", 1, 600).alias("head"))


@query(f"SELECT p.id, {_COS} AS score FROM v_point p, (SELECT dense FROM v_point ORDER BY id LIMIT 1) q ORDER BY score DESC, p.id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points, exactly."""
    return R.vector_topk(v_point(spark, sf_dir), _query_vector(spark, sf_dir), 10).select("id", "score")


@query(f"SELECT * FROM (SELECT p.id, p.label, {_COS} AS score FROM v_point p, (SELECT dense FROM v_point ORDER BY id LIMIT 1) q WHERE p.label IN (1, 4)) WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points of some groups over a threshold; groups are filtered before scoring."""
    some = v_point(spark, sf_dir).where(F.col("label").isin(1, 4))
    return R.vector_topk(some, _query_vector(spark, sf_dir), 10, 0.05).select("id", "label", "score")


@query("SELECT id, round(list_sum(list_transform(dense, lambda x: x / sqrt(list_dot_product(dense, dense)) * x)), 6) AS norm FROM v_point")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors scaled to length one."""
    return v_point(spark, sf_dir).select("id", F.round(R.dot(R.normalize(F.col("dense")), F.col("dense")), 6).alias("norm"))


@query("SELECT doc_id, vec.id IS NULL AS zeroed, CAST(coalesce(len(vec.dense), 64) AS INTEGER) AS dims FROM documents LEFT JOIN v_point vec ON vec.id = doc_id")
def zero_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: documents whose embedding failed get a zero vector."""
    d = read_table(spark, sf_dir, "documents").select("doc_id").join(v_point(spark, sf_dir), F.col("doc_id") == F.col("id"), "left")
    vector = F.coalesce("dense", F.array_repeat(F.lit(0.0), 64))
    return d.select("doc_id", F.col("id").isNull().alias("zeroed"), F.size(vector).alias("dims"))


@query("SELECT a.doc_id, min(b.doc_id) AS cached_from FROM v_document a JOIN v_document b ON substr(a.file_hash, 1, 16) = substr(b.file_hash, 1, 16) AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def embedding_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: documents whose embedding an earlier equal text has put in the cache."""
    d = v_document(spark, sf_dir).select("doc_id", F.substring("file_hash", 1, 16).alias("cache_key"))
    first = d.groupBy("cache_key").agg(F.min("doc_id").alias("cached_from"))
    return latest.look_up(d, first, ["cache_key"], "doc_id").where("doc_id > cached_from").select("doc_id", "cached_from")


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, score FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each benchmark question by BM25."""
    return _ranked(spark, sf_dir, 10)


_NEAR = f"""near AS MATERIALIZED (SELECT item_id AS query_id, p.id AS doc_id, {_COS} AS score FROM benchmark JOIN v_point q ON q.id = item_id, v_point p),
nearest AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near)"""


@query(f"""WITH {_BM25}, {_NEAR}
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM nearest WHERE rank <= 50) GROUP BY query_id, doc_id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: the sparse and the dense ranking fused by reciprocal ranks."""
    return R.reciprocal_rank_fusion([_ranked(spark, sf_dir, 50), _near(spark, sf_dir, 50)])


_TERMS = """asked AS MATERIALIZED (SELECT item_id AS query_id, item_id AS vector_id, text AS phrase FROM benchmark UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY p_brand), NULL, p_brand || ', ' || substr(p_brand, 6) || ', ' FROM (SELECT DISTINCT p_brand FROM part)),
term AS (SELECT DISTINCT query_id, trim(t) AS term FROM (SELECT query_id, unnest(string_split(phrase, ',')) AS t FROM asked) WHERE trim(t) <> ''),
named AS MATERIALIZED (SELECT DISTINCT query_id, name FROM term JOIN (SELECT DISTINCT p_brand AS name FROM part) ON contains(name, term))"""


@query(f"""WITH {_TERMS},
graph AS MATERIALIZED (SELECT query_id, chunk_id AS id, CAST(count(DISTINCT (name, type)) AS DOUBLE) AS score FROM named JOIN v_mention USING (name) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT (name, type)) DESC, chunk_id) <= 20),
near AS (SELECT query_id, p.id AS doc_id, {_COS} AS score FROM asked JOIN v_point q ON q.id = vector_id, v_point p WHERE query_id NOT IN (SELECT query_id FROM graph)),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
hit AS (SELECT query_id, doc_id, score, trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS content, phrase FROM top JOIN documents USING (doc_id) JOIN asked USING (query_id) WHERE score >= 0.4),
one AS (SELECT * FROM hit WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 100) ORDER BY score DESC, doc_id) = 1)
SELECT query_id, 'graph' AS found_by, id, score, '' AS snippet FROM graph UNION ALL
SELECT query_id, 'vector', doc_id, round(score + CASE WHEN contains(lower(content), lower(phrase)) THEN 0.3 ELSE 0 END, 4), substr(content, 1, 500) FROM one""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of entities that hold any of a query's terms, which commas part; where there are none, the nearest
    texts by vector over a threshold, one of each beginning, with a boost for those that hold the whole query."""
    brands = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    order = Window.orderBy("name")  # of the names of a query set
    two = F.concat("name", F.lit(", "), F.substring("name", 6, 1000), F.lit(", "))
    of_names = brands.select((F.row_number().over(order) + 1_000_000).cast("long").alias("query_id"), F.lit(None).cast("long").alias("vector_id"), two.alias("phrase"))
    asked = stage(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("vector_id"), F.col("text").alias("phrase")).unionByName(of_names), "asked")
    terms = asked.select("query_id", F.explode(F.split("phrase", ",")).alias("term")).select("query_id", F.trim("term").alias("term")).where("term <> ''").distinct()
    found = stage(graph.chunks_by_terms(v_mention(spark, sf_dir), terms, SubstringIndex.build(brands)), "graph")
    by_graph = found.select("query_id", F.lit("graph").alias("found_by"), F.col("chunk_id").alias("id"), F.col("entity_count").cast("double").alias("score"), F.lit("").alias("snippet"))
    points = v_point(spark, sf_dir)
    left = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    vectors = left.join(points, F.col("vector_id") == F.col("id")).select("query_id", "dense")
    near = stage(R.vector_topk_each(points, vectors, 20).where("score >= 0.4"), "near")
    texts = read_table(spark, sf_dir, "documents").select("doc_id", strip(F.col("text")).alias("content")).where("content <> ''")
    hits = texts.join(broadcast_small(near), "doc_id").join(broadcast_small(asked), "query_id")
    one = latest.first_per(hits, [F.col("query_id"), F.substring("content", 1, 100)], [F.desc("score"), F.col("doc_id")])
    boosted = F.round(F.col("score") + F.when(F.expr("contains(lower(content), lower(phrase))"), 0.3).otherwise(0.0), 4)
    return by_graph.unionByName(one.select("query_id", F.lit("vector").alias("found_by"), F.col("doc_id").alias("id"), boosted.alias("score"), F.substring("content", 1, 500).alias("snippet")))


_QUESTION = "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Brand ' || text ELSE text END AS message FROM benchmark"


@query(f"""WITH {_NEAR}, question AS ({_QUESTION}), hit AS MATERIALIZED (SELECT query_id, doc_id, rank FROM nearest WHERE rank <= 10),
word AS MATERIALIZED (SELECT query_id, term FROM (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT query_id, regexp_extract_all(message, '[A-ZА-ЯЁ]{{2,}}|[A-Za-z]{{3,}}|[а-яё]{{4,}}') AS w FROM question)) GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(place)) <= 5),
m AS MATERIALIZED (SELECT hit.query_id, v_mention.* FROM hit JOIN v_mention USING (doc_id) WHERE rank <= 5),
by_word AS MATERIALIZED (SELECT query_id, chunk_id, min(doc_id) AS doc_id, count(DISTINCT (name, type)) AS n FROM m WHERE EXISTS (SELECT 1 FROM word w WHERE w.query_id = m.query_id AND contains(m.name, w.term)) GROUP BY query_id, chunk_id),
by_message AS (SELECT query_id, chunk_id, min(doc_id) AS doc_id, count(DISTINCT (name, type)) AS n FROM m JOIN question USING (query_id) WHERE contains(name, message) AND query_id NOT IN (SELECT query_id FROM by_word) GROUP BY query_id, chunk_id),
chunk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS place FROM (SELECT * FROM by_word UNION ALL SELECT * FROM by_message)),
line AS (SELECT query_id, '[' || lpad(CAST(rank AS VARCHAR), 2, '0') || '] ' || filename || ': ' || substr(v.text, 1, 300) AS line FROM hit JOIN v_document v USING (doc_id)
UNION ALL SELECT query_id, 'graph ' || lpad(CAST(place AS VARCHAR), 2, '0') || ': doc_' || doc_id || '.txt, entities: ' || n FROM chunk WHERE place <= 5)
SELECT query_id, string_agg(line, chr(10) ORDER BY line) AS context FROM line GROUP BY query_id""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each question: its ten nearest documents, numbered, and five chunks of the first five of them
    that mention most entities whose names hold a term of the question, or the whole message where no term does."""
    question = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Brand "), "text")).otherwise(F.col("text")).alias("message"))
    hits = stage(_near(spark, sf_dir, 10), "hits")
    mentions = v_mention(spark, sf_dir)
    index = SubstringIndex.build(read_table(spark, sf_dir, "part"), "p_brand")
    only = hits.where("rank <= 5")
    terms = question.select("query_id", F.explode(F.slice(F.array_distinct(query_terms(F.col("message"))), 1, 5)).alias("term"))
    by_term = stage(graph.chunks_by_terms(mentions, terms, index, only, 5), "by-term")
    rest = question.join(by_term.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("message").alias("term"))
    chunks = by_term.unionByName(graph.chunks_by_terms(mentions, rest, index, only, 5))
    texts = v_document(spark, sf_dir).select("doc_id", "filename", "text")
    said = texts.join(broadcast_small(hits), "doc_id").select("query_id", F.concat(F.lit("["), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("] "), "filename", F.lit(": "), F.substring("text", 1, 300)).alias("line"))
    seen = chunks.select("query_id", F.concat(F.lit("graph "), F.lpad(F.col("place").cast("string"), 2, "0"), F.lit(": doc_"), F.col("doc_id").cast("string"), F.lit(".txt, entities: "), F.col("entity_count").cast("string")).alias("line"))
    return said.unionByName(seen).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("context"))  # 15 lines at most


@query()
def ml_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF and logistic regression on labelled documents, applied to all of them."""
    predicted = classify.by_tfidf(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality")
    return predicted.select("doc_id", F.col("prediction").cast("int").alias("quality"))


@query("""SELECT doc_id, chunk_index, CAST(coalesce(nullif(CASE WHEN chunk_index % 3 = 0 THEN 0 ELSE chunk_index + 1 END, 0), TRY_CAST(regexp_extract(doc_id || '_chunk_' || lpad(CAST(chunk_index + 1 AS VARCHAR), 5, '0'), '_chunk_([0-9]+)$', 1) AS INTEGER), chunk_index) AS INTEGER) AS place FROM v_chunk""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's place by its sequence number, else by the number in its id, else by its index."""
    c = chunking.numbered(v_chunk(spark, sf_dir).drop("content"))
    given = F.when(F.col("chunk_index") % 3 == 0, 0).otherwise(F.col("chunk_seq"))
    from_id = F.regexp_extract("chunk_id", "_chunk_([0-9]+)$", 1).try_cast("int")
    return c.select("doc_id", "chunk_index", F.coalesce(F.nullif(given, F.lit(0)), from_id, F.col("chunk_index")).alias("place"))


@query("""SELECT kind, known FROM (SELECT class AS kind, TRUE AS known FROM (VALUES ('contract'), ('report'), ('invoice'), ('letter'), ('other')) t(class)
UNION SELECT DISTINCT lower(p_type), FALSE FROM part WHERE length(p_type) < 40 AND lower(p_type) NOT IN ('contract', 'report', 'invoice', 'letter', 'other'))""")
def taxonomy_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected types that the taxonomy lacks extend it, if their names are short."""
    known = spark.createDataFrame([(k,) for k in ("contract", "report", "invoice", "letter", "other")], "kind string")
    found = read_table(spark, sf_dir, "part").where(F.length("p_type") < 40).select(F.lower("p_type").alias("kind")).distinct()
    new = found.join(known, "kind", "left_anti")
    return known.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False)))
