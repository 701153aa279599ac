"""Timed state, conditional fetching, tables that change together, substrings, paths, roles, posting lists."""

import io
import random
import time
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom import streaming
from docloom.functions import text as T
from docloom.operators import access, breaker, classify, execution, fetching, graph, postings, retrieval
from docloom.operators.substrings import SubstringIndex
from docloom.sources import files, web
from docloom.sources.tableset import Conflict, TableSet

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_posting_lists_equal_bm25(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, None if i == 7 else " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(300)]
    asked = [(q, " ".join(rng.choices([*words, "never"], k=rng.randint(0, 8)))) for q in range(40)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = retrieval.top_per_query(retrieval.bm25(d, q), 5).select("query_id", "doc_id", "rank", "score")
    assert rows(postings.PostingIndex.build(d).topk(q, 5)) == rows(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(postings.PostingIndex.build(empty).topk(q, 5)) == []
    assert rows(postings.PostingIndex.build(d).topk(empty.toDF("query_id", "text"), 5)) == []


def test_posting_segments_and_blocks(monkeypatch):
    """Small segments cut the same lists; bounds skip no document."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(postings, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(postings, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(2)
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [" ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(1, 12))) for _ in range(200)]})
    lists = pa.Table.from_batches(list(postings._invert(iter([docs]))))
    assert len(set(lists["segment"].to_pylist())) > 5
    for number in set(lists["segment"].to_pylist()):
        part = lists.filter(pa.compute.equal(lists["segment"], number)).filter(pa.compute.is_valid(lists.filter(pa.compute.equal(lists["segment"], number))["word"]))
        held = postings._Lists(part, 1.5, 0.75, 6.0)
        for _ in range(20):
            asked = [(i, rng.choice([-0.3, 0.1, 0.5, 2.0])) for i in rng.sample(range(part.num_rows), rng.randint(1, part.num_rows))]
            total = {}
            for i, w in asked:
                for doc, gain in zip(held.ids[i].tolist(), held.gains(i).tolist(), strict=True):
                    total[doc] = total.get(doc, 0.0) + w * gain
            best = sorted(total, key=lambda x: (-round(total[x], 6), x))[:3]
            ids, scores = held.best(asked, 3)
            assert ids.tolist() == best and scores.tolist() == pytest.approx([total[x] for x in best], abs=1e-6)


def test_substrings_equal_a_scan(spark):
    rng = random.Random(3)
    names = spark.createDataFrame([("".join(rng.choices("abé#", k=rng.randint(0, 9))),) for _ in range(300)] + [(None,)], "name string")
    said = ["", "a", "é#", "abé", "aaaa", "zz", "b#a", None, *("".join(rng.choices("abé#", k=rng.randint(1, 6))) for _ in range(40))]
    phrases = spark.createDataFrame(list(enumerate(said)), "query_id long, phrase string")
    want = phrases.join(names.distinct(), F.expr("contains(name, phrase)"))
    assert rows(SubstringIndex.build(names).matches(phrases)) == rows(want)


def test_bounded_paths(spark):
    edges = [("hub", f"n{i:03}") for i in range(200)] + [("n000", "x"), ("x", "y"), ("y", "n000"), ("a", "hub"), ("a", "a")]
    e = spark.createDataFrame([(*p, "T") for p in edges], "src string, dst string, type string")
    starts = spark.createDataFrame([("a",), ("x",), ("nowhere",)], "node string")
    near = {}
    for s, d in edges:
        if s != d:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    want = []
    for s in ("a", "x"):
        level, kept = [[s]], 0
        for _ in range(3):
            level = sorted(p + [n] for p in level for n in near[p[-1]] if n not in p)[: 50 - kept]
            kept += len(level)
            want += [(s, tuple(p)) for p in level]
    found = graph.paths(e, starts, 3, 50)
    assert sorted((r.start, tuple(r.path)) for r in found.collect()) == sorted(want)
    assert max(r["count"] for r in found.groupBy("start").count().collect()) == 50
    walked = {(s, frozenset(x)) for s, p in want for x in zip(p, p[1:], strict=False)}
    assert {(r.start, frozenset((r.src, r.dst))) for r in graph.path_edges(found, e).collect()} == walked
    assert graph.path_nodes(found).where("node = 'a' and start = 'a'").first().hops == 0


def test_roles_inherit_through_any_number(spark):
    chain = spark.createDataFrame([("f", "e"), ("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("u", "v"), ("v", "w"), ("w", "u")], "role string, parent string")
    policies = spark.createDataFrame([("a", "/x.y/*", "GET"), ("w", "/w/(1)", "GET")], "role string, glob string, method string")
    asked = [(r, "/x.y/1", "GET", True) for r in "abcdef"] + [("f", "/xzy/1", "GET", False), ("f", "/x.y/1", "PUT", False), ("u", "/x.y/1", "GET", False), ("u", "/w/(1)", "GET", True), ("z", "/x.y/1", "GET", False)]
    got = access.enforce(spark.createDataFrame([r[:3] for r in asked], "role string, resource string, method string"), policies, chain)
    assert rows(got) == sorted(asked)
    assert rows(access.closure(chain.where("role in ('u', 'v', 'w')"))) == sorted((a, b) for a in "uvw" for b in "uvw")


def test_searches_see_shared_groups_only(spark):
    docs = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (3, 7, None)], "document_id long, owner_id long, group_id long")
    users = spark.createDataFrame([(7, False), (8, True), (9, False)], "user_id long, is_admin boolean")
    member = spark.createDataFrame([(7, 1), (8, 2)], "user_id long, group_id long")
    see = lambda u: [r[0] for r in rows(access.search_filter(u, docs, users, member))]
    assert see(7) == [1] and see(8) == see(9) == [1, 2, 3]


def test_ad_hoc_sql_reads_views_only(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    spark.range(1).write.parquet(str(tmp_path / "p"))
    assert files.read_only_sql(spark, "WITH t AS (SELECT id FROM three), u AS (SELECT * FROM t) SELECT count(*) FROM u JOIN three USING (id)").first()[0] == 3
    assert files.read_only_sql(spark, "SELECT * FROM THREE WHERE id IN (SELECT max(id) FROM three)").first()[0] == 2
    for sql in ("SELECT * FROM text.`/etc/hostname`", f"SELECT * FROM parquet.`{tmp_path}/p`", "SELECT * FROM spark_catalog.default.three", "SELECT * FROM other",
                "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT * FROM (WITH other AS (SELECT 1) SELECT * FROM other), other", "INSERT INTO three SELECT 1"):
        with pytest.raises(ValueError):
            files.read_only_sql(spark, sql)


def calls(n=900, keys=3, seed=5):
    """Calls of backends, with long troubles and quiet times; several at one moment."""
    rng, t, out = random.Random(seed), dict.fromkeys(range(keys), 0), []
    for i in range(n):
        k = rng.randrange(keys)
        t[k] += rng.choice([0, 1, 3, 8, 20, 31, 400])
        bad = (t[k] // 300) % 2
        out.append((i, at(t[k]), k, "error" if rng.random() < (0.8 if bad else 0.1) else "view"))
    return out


def folded(log, limit=3, wait=30):
    out = []
    for k in {r[2] for r in log}:
        mine = sorted((r[1], r[0], r[3] != "error") for r in log if r[2] == k)
        _, found = breaker.fold(breaker.CLOSED, [(i, int((t - START).total_seconds() * 1e6), ok) for t, i, ok in mine], limit, wait * 1_000_000)
        out += [(k, *f) for f in found]
    return sorted(out)


def test_breaker_states():
    s, out = breaker.CLOSED, []
    for t, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (34, True), (35, False), (64, True), (65, True), (66, False)):
        s, change = breaker.step(s, t, ok, 3, 30)
        out.append(change)
    assert out == [None, None, None, None, None, "opened", "refused", "reopened", "refused", "closed", None] and s == (1, None)


def test_breaker_batch_and_stream_equal_one_fold(spark, tmp_path):
    log = calls()
    e = spark.createDataFrame([(*r, 0.0, "") for r in log], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    want = folded(log)
    assert {w[2] for w in want} == {"opened", "reopened", "closed", "refused"}
    batch = breaker.changes(e.withColumn("ok", F.col("event_type") != "error"), "user_id", "ts", "event_id", "ok")
    assert rows(batch) == want
    cuts = [r[1] for r in sorted(log, key=lambda r: r[1])][:: len(log) // 4]
    for a, b in zip(cuts, [*cuts[1:], at(10**8)], strict=True):  # files in order of time; a moment is in one file
        e.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)
    got = []
    stream = streaming.breaker(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), late="1 minute")
    streaming.run_available(stream, str(tmp_path / "c"), lambda df, n: got.extend(tuple(r) for r in df.collect()))
    assert sorted(got) == want


def test_files_are_out_once_settled(spark, tmp_path):
    seen = [("a", 5, 1, 0), ("a", 9, 2, 3), ("a", 9, 2, 6), ("a", 9, 2, 9), ("a", 9, 2, 12), ("b", 0, 1, 0), ("b", 0, 1, 9), ("c", 4, 1, 0), ("c", 4, 1, 5), ("c", 4, 3, 8), ("c", 4, 3, 14)]
    listed = spark.createDataFrame([(p, s, at(m), at(t)) for p, s, m, t in seen], streaming.LISTING)
    want = [("a", 9, at(9)), ("c", 4, at(5)), ("c", 4, at(14))]
    assert rows(fetching.settled(listed)) == want
    for t in sorted({t for *_, t in seen}):
        listed.where(F.col("listed_at") == F.lit(at(t))).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        time.sleep(1.05)
    got = []
    stream = streaming.settled(spark.readStream.schema(streaming.LISTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l")))
    streaming.run_available(stream, str(tmp_path / "c"), lambda df, n: got.extend(tuple(r) for r in df.collect()))
    assert sorted(got) == want


def test_a_file_written_in_parts_comes_out_whole(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    looks = []
    for part in ("one", " two", "", ""):
        with open(folder / "f.txt", "a") as f:
            f.write(part)
        looks.append(spark.createDataFrame(streaming.list_folder(spark, str(folder)).collect(), streaming.LISTING))
        time.sleep(1.2)
    every = looks[0]
    for df in looks[1:]:
        every = every.unionByName(df)
    assert [(r.size,) for r in fetching.settled(every, 1).collect()] == [(7,)]


def test_a_second_run_fetches_nothing(spark):
    heads = spark.createDataFrame([("u1", "e1", 5, 3), ("u2", None, 6, 3), ("u3", "e3", None, 4), ("u4", None, None, 2)], "url string, etag string, last_modified long, size long")
    bodies = spark.createDataFrame([("u1", "abc"), ("u2", "def"), ("u3", "ghij")], "url string, body string")
    none = spark.createDataFrame([], "url string, etag string, last_modified long, size long, page_hash string")
    first = fetching.fetched(fetching.decide(none, heads), bodies)
    assert {r.url: r.action for r in first.collect()} == {"u1": "changed", "u2": "changed", "u3": "changed", "u4": "failed"}
    state = fetching.remember(none, first)
    again = fetching.decide(state, heads.where("url <> 'u4'"))
    assert {r.action for r in again.collect()} == {"skip"}
    moved = spark.createDataFrame([("u1", "e2", 5, 3), ("u2", None, 6, 4), ("u3", "e4", None, 4)], heads.schema)
    later = fetching.fetched(fetching.decide(state, moved), spark.createDataFrame([("u1", "abc"), ("u2", "xxxx"), ("u3", "ghij")], bodies.schema))
    assert {r.url: r.action for r in later.collect()} == {"u1": "same", "u2": "changed", "u3": "same"}
    assert fetching.remember(state, later).count() == 3


def test_polls_and_watchdog(spark, tmp_path):
    got = fetching.polls(spark.range(10).withColumnRenamed("id", "tick"), spark.createDataFrame([("a", 0.5), ("b", 3.0)], "source string, every double"), F.col("every"))
    assert rows(got) == [("a", t) for t in range(10)] + [("b", t) for t in (0, 3, 6, 9)]
    seen = [3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4]
    checks = [(1, i, e, i, 100, at(i)) for i, e in enumerate(seen)] + [(2, 0, 1, 5, 10, at(0)), (2, 1, 1, 9, 10, at(1)), (2, 2, 1, 9, 10, at(2))]
    df = spark.createDataFrame(checks, "job long, check long, entities long, documents long, total long, ts timestamp")
    want = [(1, 5, "restart"), (1, 10, "restart"), (1, 16, "restart"), (2, 1, "done")]
    assert rows(fetching.watchdog(df)) == want
    for a in range(0, 20, 7):
        df.where(F.col("check").between(a, a + 6)).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        time.sleep(1.05)
    got = []
    stream = streaming.watchdog(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c")))
    streaming.run_available(stream, str(tmp_path / "k"), lambda d, n: got.extend(tuple(r) for r in d.collect()))
    assert sorted(got) == want


def test_tables_change_together(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "set"))
    points = spark.createDataFrame([(1, 1, "p"), (2, 1, "q"), (3, 2, "r")], "id long, doc_id long, v string")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    t.commit({"points": lambda old: points, "documents": lambda old: docs}, "load")
    gone = spark.createDataFrame([(1,)], "doc_id long")

    def fails(old):
        raise OSError("disk")

    with pytest.raises(OSError):
        t.commit({"documents": lambda old: old.join(gone, "doc_id", "left_anti"), "points": fails}, "broken")
    assert t.read("documents").count() == 2 and t.read("points").count() == 3
    n = t.delete_documents(gone, {"documents": "doc_id", "points": "doc_id"}, "delete")
    assert rows(t.read("documents")) == [(2, "b")] and rows(t.read("points")) == [(3, 2, "r")]
    assert t.commit({"documents": lambda old: docs}, "load") == n and t.read("documents").count() == 1
    t.put("documents", spark.createDataFrame([(2, "new"), (5, "c")], docs.schema), ["doc_id"], [F.desc("name")])
    assert rows(t.read("documents")) == [(2, "new"), (5, "c")]
    with pytest.raises(Conflict):
        t._publish(n, "{}")


def test_ingest_takes_a_batch_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    t = TableSet(spark, str(tmp_path / "set"))

    def pipeline(batch):
        docs = batch.select(F.col("sha256").alias("doc_id"), F.decode("content", "utf-8").alias("text"))
        return {"documents": (docs, ["doc_id"]), "words": (docs.select("doc_id", F.posexplode(F.split("text", " "))), ["doc_id", "pos"])}

    (folder / "a.txt").write_text("one two")
    for i in range(2):  # a lost checkpoint brings all files again
        streaming.ingest_into(streaming.watch_folder(spark, str(folder)), str(tmp_path / f"c{i}"), t, pipeline)
        assert t.read("documents").count() == 1 and t.read("words").count() == 2
    (folder / "b.txt").write_text("three")
    streaming.ingest_into(streaming.watch_folder(spark, str(folder)), str(tmp_path / "c1"), t, pipeline)
    assert t.read("documents").count() == 2 and t.read("words").count() == 3


def test_callbacks_get_each_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    seen = []
    streaming.ingest(streaming.watch_folder(spark, str(folder)), str(tmp_path / "c"), [lambda df, n: seen.append(df.count()), lambda df, n: seen.append(n)])
    assert seen == [1, 0]


def test_windows_and_sessions_as_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, at(s), u, "view", 1.0, "") for i, (s, u) in enumerate([(0, 1), (60, 1), (4000, 1), (30, 2), (10**6, 3)])], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    source = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = {}
    for name, stream in (("sessions", streaming.sessions(source())), ("sliding", streaming.sliding(source()))):
        streaming.run_available(stream, str(tmp_path / name), lambda df, n, name=name: got.setdefault(name, []).extend(tuple(r) for r in df.collect()))
    assert {(1, 2, 1), (1, 1, 2), (2, 1, 3)} <= set(got["sessions"])
    assert ("view", at(0), 3) in got["sliding"]


def test_failures_block_what_depends_on_them(spark):
    tasks = spark.createDataFrame([(i,) for i in range(1, 10)], "task long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 5), (7, 8), (8, 7), (8, 1)], "task long, needs long")
    tries = spark.createDataFrame([(1, i, i == 4) for i in range(1, 5)] + [(3, 1, True), (5, 1, False), (5, 2, True)], "task long, attempt long, ok boolean")
    want = {1: "failed", 2: "blocked", 3: "done", 4: "blocked", 5: "done", 6: "pending", 7: "blocked", 8: "blocked", 9: "pending"}
    assert dict(rows(execution.states(tasks, edges, tries))) == want
    assert {s for _, s in rows(execution.states(tasks, edges, tries.where("ok")))} == {"done", "pending"}


def test_settings_in_force(spark):
    edits = spark.createDataFrame([("a", "k", "old", 1), ("a", "k", "new", 3), ("a", "l", "x", 2), ("b", "k", "other", 9)], "preset string, kind string, value string, at long")
    switches = spark.createDataFrame([("b", 1), ("a", 2)], "preset string, at long")
    assert rows(execution.settings_in_force(edits, switches).select("kind", "value")) == [("k", "new"), ("l", "x")]


def test_names_arrays_seals_and_rules(spark):
    names = spark.createDataFrame([("a/b\\c.TXT",), ("\0x",), ("dir/",), ("..",), (".env",)], "n string")
    got = names.select(T.base_name(F.col("n")).alias("b")).select("b", T.suffix(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("c.TXT", ".txt"), ("x", ""), ("file", ""), ("file", ""), (".env", "")]
    arrays = spark.createDataFrame([("x [1, 2] [3]",), ("none",)], "t string").select(T.json_array(F.col("t"))).collect()
    assert [r[0] for r in arrays] == ["[1, 2]", ""]
    keys = spark.createDataFrame([("text", "k" * 32, "l" * 32)], "t string, a string, b string").select("t", "a", "b", T.sealed(F.col("t"), F.col("a")).alias("s"))
    assert tuple(keys.select(T.opened(F.col("s"), F.col("a")), T.opened(F.col("s"), F.col("b")), T.opened(F.lit("!"), F.col("a"))).first()) == ("text", None, None)
    docs = spark.createDataFrame([(1, "ДОГОВОР и стороны"), (2, "x" * 5000 + " invoice"), (3, None), (4, "Паспорт"), (5, "a Report on a contract")], "doc_id long, text string")
    by = classify.by_rules(docs, T.RULES, read=T.RULES_READ)
    assert {r.doc_id: (r["class"], r.confidence, r.tagged) for r in by.collect()} == {1: ("contract", 1.0, True), 2: ("other", 0.0, False), 3: ("other", 0.0, False), 4: ("identity", 0.9, True), 5: ("contract", 0.9, True)}
    sizes = spark.createDataFrame([(0, "a.pdf"), (10**9, "a.pdf"), (5, "a.exe"), (5, "a?.pdf"), (5, "A.PDF")], "s long, n string")
    assert [r[0] for r in sizes.select(T.upload_verdict(F.col("s"), F.col("n"))).collect()] == ["empty", "too_large", "extension", "forbidden_character", "ok"]


def test_office_files_open_again_and_say_what_they_are(spark, tmp_path):
    texts = spark.createDataFrame([(1, "user: a < b & c\nbot: Ж \x01!"), (2, None), (3, "")], "id long, t string")
    made = files.office_files(texts, "t").select(F.concat(F.lit("x/"), F.col("id").cast("string"), F.lit(".docx")).alias("path"), "content")
    assert rows(files.parse_files(made).select("path", "content")) == [("x/1.docx", "bot: Ж !"), ("x/1.docx", "user: a < b & c")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("docProps/core.xml", '<c:p xmlns:c="urn:c" xmlns:d="urn:d"><d:title>T</d:title><d:creator>A</d:creator></c:p>')
    some = spark.createDataFrame([("a/B.DOCX", bytearray(data.getvalue())), ("c.docx", bytearray(b"broken")), ("d", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.filename, r.extension, r.title, r.creator) for r in files.file_properties(some).collect()}
    assert got == {"a/B.DOCX": ("B.DOCX", ".docx", "T", "A"), "c.docx": ("c.docx", ".docx", None, None), "d": ("d", "", None, None)}
    pdf = spark.createDataFrame([("p.pdf", bytearray(b"x" * 60 + b"\f" + b"short"))], "path string, content binary")
    assert [r.segment_type for r in files.parse_files(pdf, lambda b: b.decode().split("\f")).orderBy("segment_index").collect()] == ["page", "scan"]
    assert files.parse_files(pdf).first().segment_type == "error"


def test_feeds_resolve_references_and_pick_the_page(spark):
    atom = '<feed><entry><title>&#1046;&#x41;&apos;&amp;lt; &#38;</title><link rel="self" href="http://s/"/><link href="http://p/?a=1&amp;b=2" rel="alternate"/></entry><entry><link rel="enclosure" href="http://e/"/></entry></feed>'
    got = web.read_feed(spark.createDataFrame([("a", atom)], "url string, xml string")).orderBy("place").collect()
    assert [(r.title, r.link) for r in got] == [("ЖA'&lt; &", "http://p/?a=1&b=2"), (None, "http://e/")]
