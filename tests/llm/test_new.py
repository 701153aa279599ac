"""Merkle manifest, exact duplicates, periodic runs; many languages; long insults."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, exact_dedup, language_id, lm_scoring, merkle, periodic_runs, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(path)
    return str(tmp_path), path


def equals_sql(spark, name, folder, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got, want = getattr(queries, name)(spark, folder), con.execute(queries.oracle_sql()[name])
    names = sorted(got.columns)
    columns = [d[0] for d in want.description]
    assert names == sorted(columns)
    key = lambda r: tuple("~" if x is None else str(x) for x in r)
    left = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    right = sorted((tuple(r[columns.index(c)] for c in names) for r in want.fetchall()), key=key)
    assert left == right
    return left, names


def documents(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 else f"é{i % 7}" if i % 2 else "zz"
        text = None if i % 19 == 0 else " ".join(rng.choice("aB c Dd  e\t f\n".split(" ")) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice([None, "en"]), source, None if text is None else len(text)))
    return rows


# --- Merkle manifest ---


def test_positions_are_the_postorder():
    def walk(n):
        """Postorder of (level, index), by recursion from the root."""
        counts = [n]
        while counts[-1] > 1:
            counts.append(-(-counts[-1] // 16))
        out = []

        def visit(level, i):
            if level:
                for j in range(16 * i, min(16 * i + 16, counts[level - 1])):
                    visit(level - 1, j)
            out.append((level, i))

        visit(len(counts) - 1, 0)
        return out

    con = duckdb.connect()
    for name, shift in (("shiftright", ">>"), ("shiftleft", "<<")):
        con.execute(f"CREATE MACRO {name}(a, b) AS (CAST(a AS BIGINT) {shift} CAST(b AS INTEGER))")
    con.execute('CREATE MACRO if_(a, b, c) AS (CASE WHEN a THEN b ELSE c END)')
    for n in (1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 273, 1000, 4097):
        order = walk(n)
        sql = merkle.position("l", "i", str(n)).replace("if(", "if_(").replace("1L", "1").replace("0L", "0")
        got = con.execute(f"SELECT {sql} FROM (VALUES {','.join(f'({k}, {l}, {i})' for k, (l, i) in enumerate(order))}) t(k, l, i) ORDER BY k").fetchall()
        assert [g for (g,) in got] == list(range(len(order)))


@pytest.mark.parametrize("n", [0, 1, 16, 17, 700])
def test_manifest_equals_sql(spark, tmp_path, n):
    rows, names = equals_sql(spark, "op11_merkle_manifest", *table(spark, tmp_path, documents(n)))
    assert len(rows) == n
    if n > 16:
        verified = [r[names.index("verified")] for r in rows]
        assert any(verified) and not all(verified)


def test_log_is_complete_and_repeats_have_leaves(spark, tmp_path):
    rows = [*documents(400), *[(7, "same", "en", "hot", 4)] * 40, (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Idx string")
    m = merkle.build(docs, queries.LEAF)
    log = m.log.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in log)
    proofs = m.proofs()
    assert proofs.count() == len(rows)
    assert proofs.where(merkle.fold(F.col("hash"), F.col("proof")) == F.col("root")).count() == len(rows)
    other = F.sha2(F.lit("x").cast("binary"), 256)
    assert proofs.where(merkle.fold(other, F.col("proof")) == F.col("root")).count() == 0


# --- exact duplicates ---


@pytest.mark.parametrize("n", [0, 1, 900])
def test_copies_equal_sql(spark, tmp_path, n):
    rng = random.Random(n)
    texts = [None, "", " \t", "a b", "ab", " a\nb ", "A b", "hot text", "hottext", "héé", "x" * 50_000] + [f"text {i}" for i in range(60)]
    rows = [(i, "hot text" if rng.random() < 0.4 else rng.choice(texts), "en", "s", 0) for i in range(n)]
    equals_sql(spark, "op12_exact_dedup", *table(spark, tmp_path, rows))


def test_runs_merge_in_rounds(spark, monkeypatch):
    """With two partners a round and blocks of three entries, many rounds and open blocks give what a dictionary gives."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["hot", "h ot", *map(str, range(150))])) for _ in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    want = {}
    for i, t in rows:
        want.setdefault(t.replace(" ", ""), []).append((-len(t), i is None, i or 0))
    monkeypatch.setattr(exact_dedup, "BLOCK", 3)
    got = exact_dedup.groups(docs).collect()
    assert len(got) == 1500 and sum(r.kept for r in got) == len(want)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        best = min(by_hash[r.text_sha256])
        assert r.keep_id == (None if best[1] else best[2]) and r.group_size == len(by_hash[r.text_sha256])
        assert not r.kept or r.doc_id == r.keep_id


def test_merge_of_overlapping_blocks(monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    rng = np.random.default_rng(2)
    e = np.zeros(900, exact_dedup.ENTRY)
    e["key"][:, 5] = rng.integers(0, 200, 900)
    e["chars"], e["id"], e["row"], e["rows"] = rng.integers(0, 3, 900), rng.integers(0, 9, 900), np.arange(900), 1
    blocks = []
    for run in range(9):
        part = exact_dedup._sorted(e[run::9])
        blocks += [part[i : i + 4] for i in range(0, len(part), 4)]
    blocks.sort(key=lambda b: tuple(b["key"][0]))
    out = np.concatenate([x for _, x in exact_dedup.merged((3, b) for b in blocks)])
    assert (out == exact_dedup._sorted(e)).all() and len(set(out["key"][:, 5].tolist())) == len(out)


def test_deduplicate_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(2, "a b", 1), (1, "ab", 2), (1, "ab", 2), (3, "c", 3)], "doc_id long, text string, Key int")
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(2, "a b", 1), (3, "c", 3)]


# --- periodic runs ---


def all_runs(w):
    """Every q and every stretch; of stretches with the same ends the smallest q is the period."""
    seen = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, blocks=6, longest=40):
    kinds, out = rng.choice([1, 2, 3, 8, 60]), []
    for _ in range(rng.randint(0, blocks)):
        out += [rng.randrange(kinds) for _ in range(rng.randint(1, longest))] * rng.choice([1, 1, 2, 3, 4, 5, 6])
        out = out[: len(out) - rng.randint(0, 3)]
    return out


def test_lyndon_lengths_by_definition():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 13))]
        want = [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[a:j] for a in range(i + 1, j))) for i in range(len(w))]
        assert periodic_runs.lyndon(w, k) == want


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        said = [repetitive(rng) for _ in range(10)]
        texts = [" ".join(f"w{x}" for x in s) for s in said]
        for s, (found, words) in zip(said, periodic_runs.texts_runs(list(range(10)), pa.array(texts)), strict=True):
            assert found == all_runs(s) and len(words) == len(s)
    assert periodic_runs.find_runs(np.zeros(5, np.int64), 1) == [] and periodic_runs.find_runs(np.zeros(6, np.int64), 1) == [(0, 6, 1)]


def test_run_query_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = rng.choice([" ", "\t ", "\n"]).join(f"w{x}" if x % 2 else f"W{x}" for x in repetitive(rng, 4, 12))
        rows.append((i if i % 9 else None if i else 0, None if i % 23 == 1 else text, "en", "s", 0))
    rows += [(1000, "", "en", "s", 0), (1001, " \n", "en", "s", 0), (1002, "ha " * 3000, "en", "s", 0), (1002, "ha " * 3000, "en", "s", 0)]
    left, names = equals_sql(spark, "op13_periodic_runs", *table(spark, tmp_path, [r for r in rows if r[0] is not None]))
    assert sum(r[names.index("n_runs")] > 0 for r in left) > 50
    got = {r.n_runs for r in periodic_runs.report(spark.createDataFrame([(None, "a " * 9), (None, None)], "doc_id long, text string")).collect()}
    assert got == {0, 1}
    assert periodic_runs.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_repeats_are_made_by_the_rule():
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(i).encode()) // 10
    n = 50
    assert periodic_runs.repeat_rule(i, n) == (g % n, 1 + (n - g % n) // (3 + g % 8))
    assert periodic_runs.repeat_rule(i, 0) is None and periodic_runs.repeat_rule(None, 9) is None


def test_collapse_and_spans(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, "plain  text"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in periodic_runs.collapse(docs).collect()} == {1: "x a b y", 2: "plain  text", 3: None}
    assert [tuple(r) for r in periodic_runs.spans(docs).collect()] == [(1, 1, 10, 2)]


# --- mended parts of earlier operators ---


def test_three_thousand_languages_learn(spark):
    rng = random.Random(1)
    rows = [(i, f"lang{i % 3000:04d}", " ".join(rng.choice("abcdefgh") * 3 + f"q{i % 3000:x}" for _ in range(4))) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.learn(docs)
    assert len(model.languages) > 2500 and model.table.shape[1] == 16
    out = language_id.identify(docs.limit(50), model).collect()
    assert len(out) == 50 and all(0 <= r.score <= 1 for r in out)


def test_long_insults_are_caught():
    rng = random.Random(9)
    plain = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20))
    for insult in ("donaudampfschifffahrter", "x" + "donaudampfschifffahrtskapitaen" * 2):
        texts = [plain() for _ in range(200)] + [f"{plain()} {insult} {plain()}" for _ in range(200)]
        model = toxicity.fit(texts, [0] * 200 + [1] * 200)
        assert model.landmarks
        new = [plain() for _ in range(50)] + [f"{plain()} {insult} {plain()}" for _ in range(50)]
        right = (toxicity.scores(new, model) >= 0.5) == np.repeat([False, True], 50)
        assert right.mean() >= 0.97
    assert toxicity.pieces_of("a" * 24) == ["a" * 24] and "".join(toxicity.pieces_of("abc" * 20))[:24] == ("abc" * 8)
    assert re.fullmatch("a+", toxicity.pieces_of("a" * 30)[1])


def test_lm_pair_expert_is_a_probability(spark):
    """After each word, what the pair expert gives to all words of the vocabulary sums to 1 at most, by counting pairs here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm_scoring.train(docs)
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    texts = [re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().translate(lower)) for r in docs.select("text").collect()]
    follow = {}
    for said in texts:
        for a, b in zip([None, *said], said, strict=False):
            follow.setdefault(a, {}).setdefault(b, 0)
            follow[a][b] += 1
    vocabulary = sorted({w for said in texts for w in said})
    joined = b" ".join(vocabulary)
    g, starts = lm_scoring.grams(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    _, _, end = lm_scoring.cuts_and_words(g, starts)
    h = g.word[end]
    number = {w: i for i, w in enumerate(vocabulary)}
    rng = random.Random(4)
    for word in [*rng.sample(vocabulary, 60), b"the"]:
        n = len(h)
        names = np.stack([np.full(n, h[number[word]]), h], axis=1).ravel()
        pair, before = lm_scoring.pair_keys(names, np.repeat(np.arange(n), 2))
        seen, times = model.pairs(before[1::2][:1])[0], model.pairs(pair[1::2])
        assert seen in (0, sum(follow.get(word, {}).values()))
        if seen:
            assert times.sum() <= seen
            assert all(t in (0, follow[word].get(w, 0)) for t, w in zip(times.tolist(), vocabulary, strict=True))


def test_many_benchmark_blocks_are_one_live_broadcast_at_a_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("matches", F.lit(1))
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    show = lambda df: sorted((str(r.doc_id), r.n_words, sorted(tuple(m) for m in r.matches)) for r in df.collect())
    one = show(decontaminate.find_matches(docs, bench))
    many = decontaminate.find_matches(docs, bench, block_words=300)
    assert show(many) == one and any(m for *_, m in one)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0


def test_pipeline_run_leaves_one_table(spark, tmp_path):
    import corpus_pipeline
    from docloom.storage import shared_dir

    for t in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "documents":
            odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (5, None, None, None, None)], rows.schema)
            rows = rows.unionByName(odd)
        rows.write.parquet(str(tmp_path / f"{t}.parquet"))
    tables = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("docloom-pipeline-*")}
    before = tables()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns and 0 < out.count() < 203
    assert out.where("text IS NULL").count() == 0
    left = sorted(tables() - before)
    assert len(left) == 1 and left[0].startswith("docloom-pipeline-mixing")


def test_lm_mixer_and_shares_come_from_every_word(spark):
    """Each decision of each symbol for training takes a step of the mixer, and each word one of the experts' shares."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lm_scoring.train(docs)
    data = [((r.text or "").encode(), len((r.text or "").split())) for r in docs.collect()]
    times = sum((np.bincount(np.frombuffer(t.lower(), np.uint8), minlength=256) for t, _ in data), np.zeros(256, np.int64))
    times[lm_scoring.END] += len(data)
    decisions = int((times * model.code.length).sum())
    assert model.mixer.seen.sum() == decisions
    assert model.mixer.near.sum() == decisions and model.mixer.met.sum() == lm_scoring.ORDERS * decisions
    assert abs(model.mixer.shares.sum() - model.n_words) < 1
