import hashlib
import io
import math
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom import adapters, streaming
from docloom.functions import text as T
from docloom.operators import access, chunking, experiments, graph, latest, retrieval, sequences
from docloom.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_uuid5_equals_the_standard_library(spark):
    names = ["42-0", "é-1", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(F.col("n")))
    assert dict(rows(got)) == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_md5_mod100(spark):
    names = [f"test-{i}" for i in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.md5_mod100(F.col("n")))
    assert dict(rows(got)) == {n: int(hashlib.md5(n.encode()).hexdigest(), 16) % 100 for n in names}


def test_assignment_buckets(spark):
    users = spark.range(500).select(F.col("id").alias("user_id"))
    got = experiments.assign(users, "t", [("a", 1), ("b", 1)]).collect()
    assert all((r.variant == "a") == (r.bucket <= 50) for r in got)


def test_dangerous_and_sanitized(spark):
    texts = [("<script>x</script>", True), ("a onclick= b", True), ("../etc", True), ("plain", False), ("union select 1", True), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r[0] for r in df.select(T.dangerous(F.col("t"))).collect()] == [d for _, d in texts]
    assert df.select(T.sanitized(F.col("t")).alias("c")).where("c LIKE '%../%' OR lower(c) LIKE '%<script>%'").count() == 0


@pytest.mark.parametrize("text", ["", "word " * 700, "x" * 2500, "a. b\nc\n\nd " * 300, "no break" + "y" * 1500 + " end"])
def test_chunk_invariants(text):
    chunks = list(chunking.recursive_chunks(text, 1000, 200))
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert set(text.split()) <= set(" ".join(chunks).split()) or len(max(text.split(), key=len)) > 1000
    at = 0
    for start, end, content in chunking.fixed_windows(text, 1000, 200):
        assert start <= at < end < len(text) + 1000 and 0 < len(content) <= 1000 or at == 0
        at = end
    assert at >= len(text) or not text.strip()


def test_chunk_rejects_large_overlap(spark):
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "fixed", 100, 60)


def test_bm25_by_hand(spark):
    docs = [(1, "a b c"), (2, "a a d"), (3, "e f"), (4, "b")]
    q = [(7, "a b b")]
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(q, "query_id long, text string"))
    toks = {i: t.split() for i, t in docs}
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "a b b".split() if w in t) for i, t in toks.items()}
    want = {i: round(s, 6) for i, s in want.items() if set(toks[i]) & {"a", "b"}}
    assert {r.doc_id: r.score for r in got.collect()} == want
    docs = spark.createDataFrame([*docs, *[(10 + i, "g g h") for i in range(30)], (50, None)], "doc_id long, text string")
    more = spark.createDataFrame([*q, (8, "g zz"), (9, "zz"), (10, None)], "query_id long, text string")
    every = retrieval.top_per_query(retrieval.bm25(docs, more), 2).select("query_id", "doc_id", "rank", "score")
    assert rows(retrieval.bm25_topk(docs, more, 2)) == rows(every) and rows(every)[-1][:3] == (8, 11, 2)


def test_vectors_for_each_query(spark):
    p = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [0.0, 0.0])], "id long, dense array<double>")
    got = rows(retrieval.vector_topk_each(p, p.select(F.col("id").alias("query_id"), "dense").where("id < 2"), 4))
    assert got == sorted([(q, r.id, i + 1, r.score) for q in (0, 1) for i, r in enumerate(retrieval.vector_topk(p, [float(q % 3), 1.0], 4).collect())])


def test_cosine_of_zero_vector(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, dense array<double>")
    assert {r.id: r.score for r in retrieval.vector_topk(p, [1.0, 1.0], 5).collect()} == {1: 0.0, 2: 1.0}


def test_entity_keepers_are_idempotent(spark):
    e = spark.createDataFrame([(1, " Acme", "org", 0.5), (2, "ACME ", "org", 0.9), (3, "acme", "place", 0.1)], "id long, name string, type string, confidence double")
    k = graph.keepers(e)
    assert rows(k) == [(1, 2), (2, 2), (3, 3)]
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 2)], "src long, dst long")
    once = graph.remap(edges, k)
    assert rows(once) == [(2, 3)] and rows(graph.remap(once, k)) == [(2, 3)]


def test_chunks_leave_a_task_in_small_batches():
    import pyarrow as pa

    texts = ["word " * 300_000, "", None] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["doc_id", "text"])
    for kind, find in (("fixed", chunking.fixed_windows), ("recursive", chunking.recursive_chunks)):
        found = list(chunking._run(kind, 1000, 200, iter([batch])))
        assert len(found) > 1 and max(sum(map(len, b.column("content").to_pylist())) for b in found) < 5_000_000
        got = [tuple(r.values()) for b in found for r in b.to_pylist()]
        assert got == [(d, i, *c) if kind == "fixed" else (d, i, c) for d, t in enumerate(texts) for i, c in enumerate(find(t or "", 1000, 200))]


def test_colinks_of_documents_of_any_size(spark):
    mentions = [(1, f"n{i}", f"t{i % 3}") for i in range(9)] + [(2, "n1", "t1"), (2, "n2", "t2"), (2, "n2", "t2"), (3, "n1", "t1")]
    want = {}
    for d in (1, 2, 3):
        own = sorted({m[1:] for m in mentions if m[0] == d})
        for a in own:
            for b in own:
                if a[1] < b[1]:
                    want[(*a, *b)] = want.get((*a, *b), 0) + 1
    got = graph.colinks(spark.createDataFrame(mentions, "doc_id long, name string, type string"), len(mentions), most=4)
    assert rows(got) == sorted((*k, n) for k, n in want.items())


def test_tasks_of_mentions_grow_in_number_not_in_size(spark):
    from docloom import plans
    from docloom.storage import dealt

    assert dealt(spark.range(10), 5_000_001, "id").rdd.getNumPartitions() == 11
    for name in ("document_entities", "graph_delete_doc", "colink_pairs"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_rules_are_tried_only_where_they_can_match(spark):
    from docloom.operators import classify

    assert classify.without_cyrillic("(плат[её]ж|чек)") is None and classify.without_cyrillic("(отч[её]т|report|анализ)") == "(report)"
    assert classify.without_cyrillic("(а?b|c[а-я]d|x)") == "(а?b|c[а-я]d|x)" and classify.without_cyrillic("(?!я)z") == "(?!я)z"
    texts = ["", None, "ДОГОВОР", "Contract", "Report Чек", "ſform", "REPORT", "статья 5 passport", "ОТЧЁТ", "latin only", "\u1c80чек"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: round(r.confidence, 6) for r in classify.by_rules(docs, T.RULES).collect()}
    each = {i: {} for i in got}
    for kind, pattern, weight in T.RULES:
        for r in docs.where(F.col("text").rlike(f"(?iu){pattern}")).collect():
            each[r.doc_id][kind] = each[r.doc_id].get(kind, 0) + weight
    assert got == {i: round(min(1.0, max(s.values(), default=0.0)), 6) for i, s in each.items()}


def test_neighbourhood_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = graph.neighbourhood(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]


def test_neighbourhood_behind_a_hub_is_whole(spark):
    pairs = [(f"s{i}", "hub") for i in range(3)] + [("hub", f"x{i:03}") for i in range(120)] + [("x000", "far"), ("far", "end"), ("s9", "x000"), ("s9", "far"), ("s8", "s8")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    starts = ["s0", "s1", "s2", "s8", "s9", "hub"]
    for depth in (1, 2, 3):
        want = set()
        for s in starts:
            seen = {s: 0}
            for hop in range(1, depth + 1):
                for n in [n for n, h in seen.items() if h == hop - 1]:
                    for m in near[n]:
                        seen.setdefault(m, hop)
            want |= {(s, n, h) for n, h in seen.items()}
        got = graph.neighbourhood(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "node string"), depth)
        assert rows(got) == sorted(want)


def test_khop_query_leaves_no_neighbour_out(spark):
    from docloom import plans
    from docloom.plans.views import v_relation

    edges = [(r.src, r.dst) for r in v_relation(spark, "/root/testdata/sf0.01").collect()]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(s, n) for s in near if s.startswith("Supplier") for m in near[s] for n in {s, m} | near[m]}
    got = rows(plans.queries()["khop_neighbors"](spark, "/root/testdata/sf0.01").select("start", "node"))
    assert got == sorted(want)


def test_visibility_order(spark):
    d = spark.createDataFrame([("d1", 1, 5), ("d2", 2, 6), ("d3", None, None)], "document_id string, owner_id long, group_id long")
    u = spark.createDataFrame([(1, False), (2, False), (9, True)], "user_id long, is_admin boolean")
    m = spark.createDataFrame([(2, 5)], "user_id long, group_id long")
    g = spark.createDataFrame([("d3", 1, "view")], "document_id string, user_id long, permission string")
    d = d.withColumn("document_id", F.substring("document_id", 2, 1).cast("long"))
    g = g.withColumn("document_id", F.substring("document_id", 2, 1).cast("long"))
    got = sorted(map(str, (tuple(r) for r in access.rules(d, u, m, g).collect())))
    assert got == sorted(map(str, [(9, "all", 0, "admin"), (2, "group", 5, "group"), (1, "document", 1, "owner"), (2, "document", 2, "owner"), (1, "document", 3, "grant")]))
    want = {1: {1: "owner", 3: "grant"}, 2: {2: "owner", 1: "group"}, 9: {1: "admin", 2: "admin", 3: "admin"}}
    assert {i: dict(rows(access.visible_to(i, d, u, m, g))) for i in want} == want


def test_read_only_queries(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    allowed = ["SELECT id FROM numbers WHERE id > 2", "WITH a AS (SELECT * FROM numbers) SELECT max(id) FROM a", "SELECT 1 WHERE 1 IN (SELECT id FROM numbers)", "SELECT id, count(*) FROM numbers GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 2"]
    for sql in allowed:
        assert files.read_only_sql(spark, sql).count() > 0, sql
    for sql in ("CACHE TABLE numbers", "DELETE FROM numbers", "UPDATE numbers SET id = 1", "ALTER TABLE numbers RENAME TO x", "TRUNCATE TABLE numbers", "DROP VIEW numbers", "INSERT INTO numbers VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a=b", "SHOW TABLES", "SELECT reflect('java.lang.System', 'exit')", "FROM numbers INSERT OVERWRITE TABLE x SELECT *", "REPLACE TABLE t AS SELECT 1"):
        with pytest.raises(ValueError):
            files.read_only_sql(spark, sql)


def test_exact_percentile_and_folds(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    data = [("a", rng.random()) for _ in range(4000)] + [("b", 7.0)] * 3000 + [("c", 1.5), ("c", None), ("d", float(rng.randrange(3)))] * 9
    df = spark.createDataFrame(data, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = dict(rows(sequences.exact_percentile(df, "k", "v", q)))
        assert all(abs(got[k] - np.quantile([v for x, v in data if x == k and v is not None], q)) < 1e-12 for k in "abcd"), q
    m = [("e", "t", i, 0, rng.random()) for i in range(2000)] + [("f", "t", 1, 0, 0.5), ("g", "t", 1, 0, 0.5), ("g", "t", 1, 1, 1.0)]
    folded = {r.name: r.confidence for r in graph.aggregate_folds(spark.createDataFrame(m, "name string, type string, doc_id long, chunk_seq long, confidence double")).collect()}
    c = m[0][4]
    for x in m[1:2000]:
        c = (c + x[4]) / 2
    assert abs(folded["e"] - c) < 1e-12 and folded["f"] == 0.5 and folded["g"] == 0.75


def test_annotations_and_backups(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"response_id": "r1", "scores": {"clear": 4, "true": 5.0}}, {"response_id": "r2", "scores": {}}]')
    assert rows(files.read_annotations(spark, str(tmp_path / "a.json"))) == [("r1", "clear", 4.0), ("r1", "true", 5.0)]
    (tmp_path / "b.json").write_text('{"ui": {"lang": "en", "size": "9"}, "ocr": {"on": "true"}}')
    back = files.read_backup(spark, str(tmp_path / "b.json"))
    now = spark.createDataFrame([("ui", "lang", "fr"), ("ui", "dark", "1")], "namespace string, key string, value string")
    assert rows(files.restore(now, back)) == [("ocr", "on", "true"), ("ui", "dark", "1"), ("ui", "lang", "en"), ("ui", "size", "9")]


def test_task_levels_go_as_deep_as_chains(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "task long, needs long")
    got = dict(rows(sequences.task_levels(spark.createDataFrame([(i,) for i in [*range(40), 100, 101]], "task long"), edges)))
    assert got == {i: i for i in range(40)}


def test_upsert_and_versions(spark, tmp_path):
    v1 = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    v2 = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k long, v string, at long")
    sinks.merge_table(spark, str(tmp_path), v1, ["k"], [F.desc("at")], 1)
    out = sinks.merge_table(spark, str(tmp_path), v2, ["k"], [F.desc("at")], 2)
    assert rows(spark.read.parquet(out)) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert latest.delete(spark.read.parquet(out), v1.select("k"), "k").count() == 1


def test_task_levels_leave_cycles_out(spark):
    tasks = spark.createDataFrame([(i,) for i in range(5)], "task long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3)], "task long, needs long")
    assert rows(sequences.task_levels(tasks, edges)) == [(0, 0), (1, 1), (2, 2)]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\n\n two \n\n\n\n".encode())
    (tmp_path / "b.csv").write_text("h,k\n1,2\n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.txt").write_bytes("caf\xe9".encode("latin-1"))
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:body></w:document>')
    got = files.parse_files(files.read_files(spark, str(tmp_path)))
    seen = {(r.path.rsplit("/", 1)[-1], r.segment_index): (r.segment_type, r.content) for r in got.collect()}
    assert seen[("a.txt", 1)] == ("text", "two") and seen[("b.csv", 0)] == ("table", "h: 1 | k: 2")
    assert seen[("c.bin", 0)] == ("error", None) and seen[("d.txt", 0)] == ("text", "café") and seen[("e.docx", 0)] == ("text", "hi")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in ("ok.txt", "../evil.txt", ".hidden.txt", "x.exe"):
            z.writestr(n, "t")
    arc = spark.createDataFrame([("z", bytearray(data.getvalue()))], "path string, content binary")
    assert [r.path for r in files.unpack(arc).collect()] == ["ok.txt"]


def test_read_only_sql(spark):
    assert files.read_only_sql(spark, "SELECT 1 AS OFFSET_").count() == 1
    for bad in ("DROP TABLE x", "CREATE TABLE x (a int)", "SET a = 1", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            files.read_only_sql(spark, bad)


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    got = []
    streaming.run_available(streaming.tumbling(stream, late="40 days"), str(tmp_path / "c1"), lambda df, _: got.extend(df.collect()), "update")
    last = {(r.event_type, r.start): r.n for r in got}
    want = e.groupBy("event_type", F.window("ts", "1 hour").start.alias("start")).count().collect()
    assert sum(last.values()) == 1000 and last == {(r.event_type, r.start): r["count"] for r in want}
    seen = []
    streaming.run_available(streaming.admit(stream, 2, 3600, "40 days"), str(tmp_path / "c2"), lambda df, _: seen.extend(df.collect()))
    assert len({r.event_id for r in seen}) == 1000 and any(r.admitted for r in seen)
    opened = []
    streaming.run_available(streaming.consecutive_failures(stream, 2, "40 days"), str(tmp_path / "c3"), lambda df, _: opened.extend(df.collect()))
    first = []
    streaming.run_available(streaming.first_seen(stream, ["user_id"], "40 days"), str(tmp_path / "c4"), lambda df, _: first.extend(df.collect()))
    assert len(first) == e.select("user_id").distinct().count()


def test_adapters(spark):
    df = spark.createDataFrame([(1, "a b. c"), (2, None)], "i long, t string")
    got = adapters.apply(df, "t", "v", adapters.hash_embedding, "array<double>").collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-9 and not any(got[1].v)
    assert [r.a for r in adapters.apply(df, "t", "a", adapters.extractive_answer, "string").collect()] == ["a b", ""]


def test_handlers_feeds_and_pages(spark, tmp_path):
    from docloom.sources import web

    adapters.register_handler("upper", lambda t: t.select("task_id", F.upper("payload").alias("result")))
    tasks = spark.createDataFrame([(1, "upper", "a"), (2, "none", "b"), (3, None, "c")], "task_id long, kind string, payload string")
    assert rows(adapters.run_tasks(tasks)) == [(1, "A", None), (2, None, "no handler for none"), (3, None, "no handler for null")]
    rss = "<rss><channel><item><title>A & B &lt;c&gt;</title><link>http://x/?a=1&b=2</link><pubDate>Mon</pubDate><enclosure url=\"http://x/f.pdf\"/></item><item><title><![CDATA[ D ]]></title></item></channel></rss>"
    atom = "<feed><entry><title type=\"text\">E</title><link href=\"http://y/\"/><updated>Tue</updated><summary>s</summary></entry></feed>"
    got = web.read_feed(spark.createDataFrame([("r", rss), ("a", atom), ("n", None), ("z", "no xml")], "url string, xml string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("r", 0, "A & B <c>", "http://x/?a=1&b=2", "Mon", None, "http://x/f.pdf"), ("r", 1, "D", None, None, None, None), ("a", 0, "E", "http://y/", "Tue", "s", None)], key=str)
    pages = [("<body><nav>n</nav><article><p>One<b>two</b></p><script>x</script> three</article></body>", "One two three"), ("<p>a</p>", "a"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(h,) for h, _ in pages], "h string").select(T.main_text(F.col("h"))).collect()] == [t for _, t in pages]
    sinks.insert_notifications(spark.createDataFrame([(1, "k", "m")], "user_id long, kind string, message string"), str(tmp_path / "n"))
    assert [(r.user_id, r.read) for r in spark.read.parquet(str(tmp_path / "n")).collect()] == [(1, False)]


def test_merges_and_rebuilds(spark):
    e = spark.createDataFrame([(1, " Acme", "org"), (2, "ACME ", "org"), (3, "x", "org")], "id long, name string, type string")
    edges = spark.createDataFrame([(3, 2, "K"), (2, 3, "K"), (1, 2, "K"), (1, 3, "K")], "src long, dst long, type string")
    assert rows(graph.merge_into_lowest(edges, e)) == [(1, 3, "K"), (1, 3, "RELATED_TO"), (3, 1, "MENTIONS")]
    m = spark.createDataFrame([("a", "t", 1, 1), ("a", "t", 1, 5), ("b", "t", 1, 5), ("b", "t", 2, 1)], "name string, type string, doc_id long, chunk_seq long")
    assert rows(graph.rebuild(m, m, spark.createDataFrame([(1,)], "doc_id long"), 2)) == [("a", "t", 1, 1, True), ("b", "t", 1, 1, False)]


def test_cache_with_a_time_to_live(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    spark.createDataFrame([(i, at(s), u) for i, (s, u) in enumerate([(0, 1), (3, 1), (10, 1), (11, 1), (25, 1), (3, 2)])], "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    got = []
    streaming.run_available(streaming.ttl_cache(stream, 10), str(tmp_path / "c"), lambda df, _: got.extend(map(tuple, df.collect())))
    assert sorted(got) == [(0, 1, False), (1, 1, True), (2, 1, False), (3, 1, True), (4, 1, False), (5, 2, False)]


def test_classifier_on_held_out_texts(spark):
    from docloom.operators import classify

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality"), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = classify.train_tfidf(d.where(~held), "quality").transform(d.where(held)).select("quality", "prediction").collect()
    most = max(sum(r.quality == y for r in got) for y in (0, 1)) / len(got)
    assert sum(r.quality == r.prediction for r in got) / len(got) > most


def test_look_up_by_broadcast_and_by_salt(spark):
    r = spark.createDataFrame([(i, i % 3 if i % 2 else 0) for i in range(60)], "i long, k long")
    f = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = sorted((k, i, "ab"[k]) for i, k in ((i, i % 3 if i % 2 else 0) for i in range(60)) if k < 2)
    for most in (10, 1):
        assert rows(latest.look_up(r, f, ["k"], "i", most=most).select("k", "i", "v")) == want


def test_texts_are_cut_to_terms_once_for_fitting_and_prediction(spark):
    from docloom.operators import classify

    texts = [(i, None if i == 30 else f"{'good fine' if i % 2 else 'bad poor'} text {i % 5}") for i in range(31)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(25, None), (30, 1)], "doc_id long, quality int")
    got = {r.doc_id: int(r.prediction) for r in classify.by_tfidf(d, labels, "quality").collect()}
    assert len(got) == 31 and all(got[i] == i % 2 for i in range(30))
    assert read.value == 31


def test_chunks_are_counted_behind_one_shuffle_of_mentions(spark):
    import re

    from docloom.operators.substrings import SubstringIndex

    said = [(c, c // 3, n, t) for c in range(12) for n, t in (("Brand#1", "x"), ("Brand#1", "x"), (f"Brand#{c % 4}", "y"), ("other", "z"))]
    mentions = spark.createDataFrame(said, "chunk_id long, doc_id long, name string, type string")
    terms = spark.createDataFrame([(7, "#1"), (7, "Brand#2"), (8, "#3"), (9, "none")], "query_id long, term string")
    got = graph.chunks_by_terms(mentions, terms, SubstringIndex.build(mentions), most=5)
    want = []
    for q, held in ((7, ("#1", "Brand#2")), (8, ("#3",))):
        count = {c: len({(n, t) for k, _, n, t in said if k == c and any(h in n for h in held)}) for c in range(12)}
        best = sorted((-n, c) for c, n in count.items() if n)[:5]
        want += [(q, c, c // 3, -n, i + 1) for i, (n, c) in enumerate(best)]
    assert rows(got) == sorted(want)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", got._jdf.queryExecution().executedPlan().toString())


def test_segment_of_postings_holds_four_bytes_a_word():
    from docloom.operators.postings import _Segment

    segment = _Segment()
    for i in range(50):
        segment.add(90 - i, f"a b b w{i % 7} a")
    segment.add(5, None)
    assert sum(x.nbytes for x in segment.said) == 4 * segment.words == 1000
    head, lists = segment.rows(3)
    assert head.to_pylist()[0]["words"] == 250 and not segment.said
    a, b = lists.to_pylist()[:2]
    assert (a["word"], a["n"], a["max_tf"], a["min_dl"], len(a["ids"])) == ("a", 50, 2, 5, 400) and (b["word"], b["max_tf"]) == ("b", 2)


def test_starts_and_nodes_of_a_class_are_paired_whole_in_any_tiles(spark):
    member = [(f"s{i}", "a") for i in range(37)] + [("t", "b"), ("u", "c")]
    reached = [("a", f"s{i}", 2) for i in range(37)] + [("a", f"x{i}", 1 + i % 2) for i in range(50)] + [("b", "x0", 1), ("b", "t", 2), ("d", "x1", 1)]
    want = sorted((s, n, h) for s, c in member for k, n, h in reached if k == c and s != n)
    for sizes in ((2, 5, 7), (3, 1000, 10), (256, 16_384, 1_000_000)):
        got = graph.each_with_each(spark.createDataFrame(member, "start string, class string"), spark.createDataFrame(reached, "class string, node string, hops int"), *sizes)
        assert rows(got) == want, sizes


def test_neighbourhood_of_starts_with_the_same_nodes_takes_little_disk(spark, tmp_path):
    starts = spark.range(1500).selectExpr("'Supplier ' || id AS src", "'hub ' || id % 3 AS dst")
    edges = starts.unionByName(spark.range(500).selectExpr("'Customer ' || id AS src", "'hub ' || id % 3 AS dst"))
    graph.neighbourhood(edges, starts.selectExpr("src AS node"), 2).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1500 * 2 + 500 * (1500 + 500) - 1500
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 400_000
