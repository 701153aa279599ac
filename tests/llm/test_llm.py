"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and odd columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, chat, decontaminate, jaccard_join, language_id, lm_scoring, mixing, token_counts, toxicity, warc
from docloom.llm._components import components
from docloom.llm._text import chunks, words

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, score string, n string"


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with what operators add."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", "x", None) for i, t in enumerate(texts)], DOCS)


def noisy(rng, base, share):
    return " ".join(f"w{rng.randrange(900)}" if rng.random() < share else w for w in base.split())


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    texts = [None, "", "  \n", "one", "One", "a b c d", "A b c d", "\x0b", "é é"]
    for n in (5, 6, 9, 14, 30, 80, 200, 500):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(n))
        texts += [base, base.upper(), base, *(noisy(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05)), base + " tail", " ".join(base.split()[1:]), "shared passage of words here " * 3 + base[: n // 2]]
        drift = base
        for _ in range(6):
            drift = noisy(rng, drift, 0.015)
            texts.append(drift)
    texts.append("long " * 30_000)
    return texts


def shingle_sets(texts):
    out = []
    for t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def by_force(sets, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words_equal_a_pattern():
    texts = ["", None, "Ab c", "é-x\x85y", "a\x1fb", " lead", "tail ", "x" * 5000, "\x00 0"]
    for inside, pattern in ((None, SPACED), (decontaminate.ALNUM, ALNUM)):
        for _, _, data, offsets in chunks(pa.array(texts)):
            rows, _, lengths = words(data, offsets) if inside is None else words(data, offsets, inside)
            want = [(i, len(w.encode())) for i, t in enumerate(texts) for w in pattern.findall((t or "").translate(LOWER))]
            assert list(zip(rows.tolist(), lengths.tolist(), strict=True)) == want


def test_join_equals_brute_force(spark, near_texts):
    ids = [7 * i % 1009 for i in range(len(near_texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(table(spark, near_texts, ids)).collect()}
    sets = shingle_sets(near_texts)
    want = by_force(sets, ids)
    assert got == {i: (len(s), want[i]) for i, s in zip(ids, sets, strict=True)}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(2, 40), 75, 150, 400]:
        for _ in range(8):
            pool = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
            rng.shuffle(pool)
            drop = rng.integers(0, n // 5 + 1)
            a, rest = pool[:n], pool[n:]
            b = np.concatenate([a[drop:], rest[: rng.integers(0, n // 5 + 1)]])
            if len(b) and jaccard_join.linked(n - drop, len(a), len(b)) and set(a.tolist()) != set(b.tolist()):
                assert set(jaccard_join.signatures(np.sort(a)).tolist()) & set(jaccard_join.signatures(np.sort(b)).tolist()), n


def test_join_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "a b c d e f"), (4, "zz")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 0, 3), (4, 2, 1), (4, 1, 1)], key=str)
    kept = jaccard_join.deduplicate(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, "a b c d e f"), (3, None)] and len(kept) == 3
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_join_keeps_all_links_of_an_original_with_many_edits(spark):
    original = [f"w{i}" for i in range(904)]
    texts = [" ".join(f"e{k}x{i}" if 100 * k <= i < 100 * k + 86 else w for i, w in enumerate(original)) for k in range(9)]
    texts, ids = [*texts, " ".join(original)], [*range(1, 10), 100]  # each edit links with the original alone
    want = by_force(shingle_sets(texts), ids)
    assert set(want.values()) == {1}
    assert {r.doc_id: r.component_id for r in jaccard_join.join(table(spark, texts, ids)).collect()} == want


def test_join_of_a_large_mixed_group(spark, monkeypatch):
    """Many texts share a passage, and so signatures; blocks and several rounds are needed to part and to link them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(12):
        own = base + [f"{k}x{i}" for i in range(13 + k % 3)]
        texts += [" ".join(own), " ".join([*own, "tail"]), " ".join(own[1:])]
    texts += [" ".join([*base, *(f"z{rng.randrange(99)}" for _ in range(2))]) for _ in range(15)] + ["once more " * 30] * 9
    ids = rng.sample(range(1000), len(texts))
    for small in (2_000_000, 3):  # joins by broadcast, then all by shuffle
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", small)
        want = by_force(shingle_sets(texts), ids)
        assert {r.doc_id: r.component_id for r in jaccard_join.join(table(spark, texts, ids)).collect()} == want


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    w = [f"t{i}" for i in range(60)]
    items = [" ".join(rng.choices(w, k=k)) for k in (1, 3, 9, 10, 11, 40)] + ["", None, "T1, t1"]
    items[0] = "zq"
    docs = [None, "", items[5].upper(), "x " + items[3].replace(" ", "--") + " y " + items[5][:60], "zq zq", items[4] + " " + items[4], "t1 t1", " ".join(rng.choices(w, k=3000)), "no match"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(5, items[5])], "item_id long, text string")
    want = {}
    parsed = [(str(i), ALNUM.findall((t or "").translate(LOWER))) for i, t in enumerate(items)]
    for d, t in enumerate(docs):
        dw, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for i, iw in parsed:
            m = min(10, len(iw))
            for k in range(len(iw) - m + 1 if iw else 0):
                for at in range(len(dw) - m + 1):
                    if dw[at : at + m] == iw[k : k + m]:
                        hit.update(range(at, at + m))
                        found.add(i)
        want[d] = (len(dw), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = decontaminate.contamination(table(spark, docs), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    split = decontaminate.find_matches(table(spark, docs), bench, block_words=20)
    assert split.select("doc_id", F.explode("matches.item_id")).distinct().count() == sum(v[2] for v in want.values())
    assert split.select("doc_id", F.sort_array("matches").alias("m")).collect() == decontaminate.find_matches(table(spark, docs), bench).select("doc_id", F.sort_array("matches").alias("m")).collect()
    kept = decontaminate.decontaminate(table(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]} and kept.columns == table(spark, docs).columns
    assert decontaminate.contamination(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_row(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(None, "clean words here"), (7, "clean seven row"), (None, f"x {item} y"), (7, item), (8, item[:-4]), (9, None), (7, "clean seven row")]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, n_words int, matches string")
    bench = spark.createDataFrame([(None, item), ("b", item + " tail"), ("c", ""), (None, None)], "item_id string, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text, r.n_words, r.matches) for r in kept.where("doc_id is not null").collect()) == sorted([(7, "clean seven row", 1, "m")] * 2 + [(9, None, 1, "m")], key=str)
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["clean words here"]
    named, none = (hashlib.sha256(s).hexdigest() for s in (b"b", b""))
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, bench).collect())
    assert got == sorted([(3, 0, 0, none)] * 3 + [(14, 12, 2, named), (12, 12, 2, named), (11, 11, 2, named), (0, 0, 0, none)])
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_suffixes_are_in_full_order_and_matches_are_longest(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 400))) for _ in range(12)] + [" ".join("ab" * 300)] * 3
    tests = decontaminate.build_tests([(str(i), t) for i, t in enumerate(texts[:4])])
    for _, _, data, offsets in chunks(pa.array([t.replace("b", "b", 1) + " zz a b" for t in texts])):
        rows, hashes, _ = words(data, offsets, decontaminate.ALNUM)
        slot = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        numbers = np.where(tests.vocabulary[slot] == hashes, slot + 1, 0)
        _, at = decontaminate.suffix_array(numbers, rows, 3, 10)

        def suffix(p):
            end = p
            while end < len(rows) and rows[end] == rows[p] and numbers[end]:
                end += 1
            return numbers[p:end].tolist()

        every = [suffix(p) for p in range(len(rows))]
        assert at.tolist() == sorted((p for p in range(len(rows)) if len(every[p]) >= 3), key=lambda p: (every[p], p))
    items, docs = texts[:4], texts[4:8]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, *m) for r in decontaminate.find_matches(table(spark, docs), bench).collect() for m in r.matches}
    want = set()
    for d, t in enumerate(docs):
        for i, u in enumerate(items):
            x, y = t.split(), u.split()
            for p in range(len(x)):
                for q in range(len(y)):
                    if p and q and x[p - 1] == y[q - 1]:
                        continue
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= min(10, len(y)):
                        want.add((d, str(i), p, q, n))
    assert got == want


def test_chat_collapse(spark):
    logs = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["x"], 5: [None, "y"], 6: [None], 7: [""], 8: ["a", "c"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", s, 0) for c, said in logs.items() for t, s in enumerate(said)]
    rows += [(9, None, None, "n", 0), (None, 0, "user", "lost", 0), (4, 0, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    assert set(got) == {2, 4, 5, 7, 8, 9, None}
    assert got[2] == (3, "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n") and got[4][0] == 2
    assert got[9][1] == "<|unknown|>\nn\n<|end|>\n" and chat.render(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = '<html><head><title>T &amp; t</title><script>var x="<p>";</script></head><body><p>One <b>two</b></p><a href="/x">l</a><br>é&nbsp;z</body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page, "q"), (2, None, None, "q"), (None, "http://b/", "", "q"), (1, "http://a/", page, "q")], "page_id long, url string, html string, block string")
    resp = warc.responses(pages)
    recs = warc.derive(resp).collect()
    assert len(recs) == 8
    conv = next(r for r in recs if r.source_id == "1" and r.record_type == "conversion")
    meta = next(r for r in recs if r.source_id == "1" and r.record_type == "metadata")
    source = next(r for r in resp.collect() if r.source_id == "1")
    assert bytes(conv.block).decode() == "One two\nl\né z" and conv.refers_to == meta.refers_to == source.record_id
    assert conv.payload_digest == source.payload_digest == warc.digest(page.encode()) and conv.block_digest == warc.digest(bytes(conv.block))
    assert '"title":"T & t"' in bytes(meta.block).decode() and "text/html" in bytes(meta.block).decode()
    packed = warc.pack(warc.derive(resp), 3).collect()
    for i, p in enumerate(packed):
        (tmp_path / f"{i}.warc.gz").write_bytes(bytes(p.warc))
    back = warc.read(spark, str(tmp_path)).collect()
    key = lambda r: (r.record_id, r.record_type, r.refers_to, bytes(r.block), r.block_digest, r.payload_digest, r.content_type)
    assert sorted(map(key, back), key=str) == sorted(map(key, recs), key=str)


def test_warc_odd_records_and_texts(spark):
    record = lambda length, block: b"WARC/1.0\r\nWARC-Type: response\r\n" + length + b"\r\n" + block + b"\r\n\r\n"
    data = record(b"Content-Length: x\r\n", b"one") + record(b"", b"two\nlines") + record(b"Content-Length: -4\r\n", b"") + record(b"Content-Length: 5\r\n", b"three") + b"junk\n" + record(b"Content-Length: 99999999999999999999\r\n", b"rest")
    assert [r["block"] for r in warc.parse(data)] == [b"one", b"two\nlines", b"", b"three", b"rest\r\n\r\n"]
    packed = gzip.compress(record(b"Content-Length: 3\r\n", b"abc")) + gzip.compress(record(b"Content-Length: 3\r\n", b"def"))
    assert [r["block"] for r in warc.parse(packed)] == [b"abc", b"def"] and [r["block"] for r in warc.parse(packed[:-30])][:1] == [b"abc"]
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"\x1f\x8bxx")) == []
    pages = spark.createDataFrame([(1, "u", "<p>" + "long text " * 200_000 + "</p>", "x"), (2, "u", "<p>no end <b", None), (3, "u", "\x00<", None)], "page_id long, url string, html string, refers_to string")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    found = {r.source_id: bytes(r.block) for r in warc.derive(warc.responses(pages)).collect() if r.record_type == "conversion"}
    assert len(found) == 3 and found["1"].count(b"long text") == 200_000


def test_mixing_reaches_its_marginals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.randrange(1, 50)) for i in range(4000)] + [(None, "a", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, weight long")
    aims = {"source": {"a": 2, "b": 1, "zz": 5}, "lang": {"x": 1, "y": 1}}
    run = lambda **k: mixing.mix(df, ["source", "lang"], F.col("weight"), targets=aims, share=0.2, **k).toPandas()
    got = run()
    assert len(got) == len(rows) and (got[got.source == "(none)"].prob == 0).all()
    mass = got.assign(m=got.prob * got.n_tokens)
    by = mass.groupby("source").m.sum() / mass.m.sum()
    assert abs(by["a"] - 2 / 3) < 1e-3 and abs(mass.m.sum() - 0.2 * got.n_tokens.sum()) < 1e-3 * got.n_tokens.sum()
    assert abs(got.sampled.mean() - got.prob.mean()) < 0.03
    small = spark.createDataFrame(rows[:300], df.schema)
    a = mixing.mix(small, ["source", "lang"], F.col("weight"), share=0.3, rounds=4).toPandas()
    b = mixing.mix(small, ["source", "lang"], F.col("weight"), share=0.3, rounds=4, driver_cells=3).toPandas()
    assert np.allclose(a.sort_values("doc_id").prob, b.sort_values("doc_id").prob, atol=1e-9)
    how = dict(power={"lang": 0.2}, targets={"source": {"a": 1, "b": 3}}, share=0.3, rounds=4)
    a, b = (mixing.mix(small, ["source", "lang"], F.col("weight"), driver_cells=n, **how).toPandas().sort_values("doc_id") for n in (100, 3))
    assert np.allclose(a.prob, b.prob, atol=1e-9) and 0 < a.sampled.sum() < 300
    odd = small.unionByName(small.limit(20)).withColumn("__dim0", F.lit(1)).withColumn("prob", F.lit("x"))
    for n in (100, 3):
        got = mixing.sample(odd, {"source": F.col("source"), "lang": F.col("lang")}, F.col("weight"), driver_cells=n, **how)
        want = mixing.mix(odd, ["source", "lang"], F.col("weight"), driver_cells=n, **how).where("sampled")
        assert got.columns == odd.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in want.collect())))
    assert mixing.sample(df.limit(0), {"source": F.col("source")}, F.col("weight")).count() == 0
    assert mixing.mix(df.limit(0), ["source", "lang"], F.col("weight")).count() == 0


def test_lm_base_is_exact_and_scores_sum_to_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(100_001, None), (100_002, ""), (None, "the the"), (3, "the")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [SPACED.findall(t.translate(LOWER)) for _, t in rows]
    count, ends = collections.Counter(w for (i, _), t in zip(rows, tokens, strict=True) if not held(i) for w in t), sum(not held(i) for i, _ in rows)
    n = sum(count.values()) + ends
    scale = n + 0.1 * (len(count) + 2)
    want = sorted((str(i), len(t) + 1, sum(count[w] > 0 for w in t) + 1, n, round(sum(math.log10((count[w] + 0.1) / scale) for w in t) + math.log10((ends + 0.1) / scale), 4)) for (i, _), t in zip(rows, tokens, strict=True))
    found = lm_scoring.score(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)
    model = lm_scoring.train(docs.where("doc_id < 60"))
    key = np.arange(256, dtype=np.uint64) | np.uint64(0x6568742000)
    every = model.log10(lm_scoring.Grams(key, np.full(256, 12345, np.uint64)))
    assert abs((10**every).sum() - 1) < 1e-3
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    for sf in ("0.01", "0.1"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").withColumn("n_bytes", F.lit("x")).withColumn("row", F.lit(None).cast("string"))
        r = lm_scoring.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg("bits_per_byte").alias("bits")).first()
        assert r.s > 0.93 * r.b and r.bits < 2.1, sf


def test_lm_score_by_brute_force(spark):
    """Each text's score from the model's parts, one symbol, one decision and one word at a time."""
    texts = ["", None, "a", " a", "The cat sat on the mat.\n\nThe dog  sat.", "the cat", "zyx \u0434\u0443\u0431", "the cat sat on the mat " * 40, "x" * 3000, " \n\t"]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(60)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = lm_scoring.train(docs.where("crc32(cast(string(doc_id) as binary)) % 10 <> 0"))
    taught = [texts[i % len(texts)] or "" for i in range(60) if not held(i)]
    count = collections.Counter(w for t in taught for w in SPACED.findall(t.translate(LOWER)))
    assert model.n_words == count.total() and abs(model.cut.sum() - 1) < 1e-12
    symbols = collections.Counter(b for t in taught for b in [*t.translate(LOWER).encode(), 0xFF])
    assert (model.code.length == lm_scoring.Code(np.array([symbols[b] for b in range(256)])).length).all()
    m = model.mixer
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    for d, t in enumerate(texts):
        t = (t or "").translate(LOWER)
        said = [*t.encode(), 0xFF]
        g, _ = lm_scoring.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(said) - 1]))
        value = []
        for i, symbol in enumerate(said):
            contexts, log = lm_scoring._contexts(g[i : i + 1]), 0.0
            for b in range(model.code.length[symbol]):
                node, bit = model.code.node[b, symbol], int(model.code.bit[b, symbol])
                found = [int(model.state[lm_scoring._slot(o, c, np.array([node], np.uint32))[0]]) for o, c in enumerate(contexts)]
                longest = max((o + 1 for o, x in enumerate(found) if x >= 31), default=0)
                often = min(3, (found[longest - 1] // 31 - 1) // 2) if longest else 0
                w = m.weights[(min(b, 7) * (lm_scoring.ORDERS + 1) + longest) * 4 + often]
                mixed = min(12, max(-12, sum(w[o] * m.stretch[o][x] for o, x in enumerate(found)) + 0.3 * w[-1]))
                at = min(7.999, max(-7.999, mixed)) * 2 + 16
                low = m.refine[node, int(at)] * (1 - at % 1) + m.refine[node, int(at) + 1] * (at % 1)
                p = min(1 - 1e-6, max(1e-6, 0.5 / (1 + math.exp(-mixed)) + 0.5 * low))
                log += math.log10(p if bit else 1 - p)
            value.append(log)
        total, at, last = 0.0, 0, None
        while at < len(said):
            end = at
            while said[end] not in (0x20, *range(9, 14), 0xFF):
                end += 1
            if end == at:
                total += value[at] + math.log10(m.share[:, 0].min())
            else:
                word = bytes(said[at:end])
                h = lambda x: lm_scoring.grams(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].word[-1:]
                both, before = lm_scoring.pair_keys(np.concatenate([h(last), h(word)]) if last else h(word), np.zeros(2 if last else 1, np.int64))
                seen, pair = int(model.pairs(before)[-1]), int(model.pairs(both)[-1])
                share = m.share[sum(seen >= x for x in (1, 2, 4, 16, 256))]
                q = model.cut[said[end]]
                total += math.log10(share[0] * 10 ** sum(value[at : end + 1]) + share[1] * count[word.decode()] / model.n_words * q + share[2] * (min(1, pair / seen) if seen else 0) * q)
                last = word
            at = end + 1
        for i in range(d, 60, len(texts)):
            assert abs(got[i].score - total) < 1e-3 * max(1, -total), (d, i)
            assert abs(got[i].bits_per_byte * len(said) + total * math.log2(10)) < 1e-2 * max(1, -total)


def test_lm_pairs_and_blocks_pack_and_add_up():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.01, 0.6):
        n = np.where(rng.random(1 << 16) < share, rng.integers(1, 700, 1 << 16), 0)
        data = lm_scoring._pack(n) + b"rest"
        back, read = lm_scoring._unpack(data)
        assert (back == n).all() and data[read:] == b"rest"
    key = np.unique(rng.integers(0, 1 << (16 + lm_scoring.CHECK_BITS), 5000))
    n = rng.integers(1, 900, len(key))
    assert all((x == y).all() for x, y in zip(lm_scoring._unpack_pairs(lm_scoring._pack_pairs(key, n)), (key, n), strict=True))


def test_ann_equals_brute_force_where_it_probes_all(spark):
    rng = np.random.default_rng(8)
    x = [rng.normal(size=8).tolist() for _ in range(120)]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(200 + i, x[0], 0) for i in range(40)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] + [1.0] * 7, 0), (5, x[5], 0), (None, x[3], 0), (320, [1.0, 2.0], 0), (321, [1.0] * 9, 0), (340, [1.0, float("inf")], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20, centroids=4, recall=1.0).collect()
    live = {i: np.array(v) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    hits = total = 0
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        want = sorted((-float(live[q] @ v), i) for i, v in live.items() if i != q)[:20]
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - live[q] @ live[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in want})
        total += 20
    assert {r.query_id for r in got} == {i for i in live if i % 20 == 0} and hits / total >= 0.95
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_blocks_split_and_share(spark, monkeypatch):
    assert ann.block_bounds(np.array([3, 3, 0, 25, 1, 9, 9]), 10).tolist() == [0, 0, 0, 1, 4, 4, 5, 6]
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 6)), 9 + rng.normal(size=(300, 6)) * 0.01])  # one crowded cell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SLICE_QUERIES", 7)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=5, centroids=4, recall=1.0).collect()
    hits = [len({r.vec_id for r in got if r.query_id == q} & {i for _, i in sorted((-float(x[q] @ v), i) for i, v in enumerate(x) if i != q)[:5]}) for q in range(0, 500, 20)]
    assert np.mean(hits) >= 4.75 and len(got) == 125


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = collections.defaultdict(set)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        found[r.query_id].add(r.vec_id)
    recall = [len(found[q] & {i for _, i in sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]}) / 20 for q in x if q % 20 == 0]
    assert np.mean(recall) >= 0.9


def test_token_counts_equal_the_unigram_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_counts.read_vocabulary()
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a ", "a\n\nb\tc", "中文 漢字", "😀x😀", "▁▁a ▁", "<s> <0x41>", "é" * 300, "a" * 5000]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, [*texts, None])).collect()}
    assert got == {i: len(e.ids) for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))} | {len(texts): 0}
    small = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0)])
    assert small.count("aaa") == 3 and small.count("bb") == 2


def test_empty_tables_repeats_and_long_texts(spark):
    docs = table(spark, ["a b", "a b", "a b", None, "word " * 200_000], [1, 1, None, 2, 3])
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == 5 and len({r.n_tokens for r in got if r.text == "a b"}) == 1 and max(r.n_tokens for r in got) >= 200_000
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    said = spark.createDataFrame([(1, 0, "user", "long " * 200_000), (1, 1, "user", None), (1, 1, "user", None), (2, 0, "user", "long " * 200_000)], "conv_id long, turn long, role string, text string")
    out = chat.render(said).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(1, 3)] and out[0].rendered.count("long ") == 200_000
    same = spark.createDataFrame([(7, "a", 10)] * 5 + [(8, "b", 10)] * 5, "doc_id long, source string, w long")
    mixed = mixing.mix(same, ["source"], F.col("w"), share=0.5).collect()
    assert len(mixed) == 10 and {r.prob for r in mixed} == {0.5} and len({(r.doc_id, r.sampled) for r in mixed}) == 2


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(df)
    out = language_id.identify(df, model).where("crc32(cast(string(doc_id) as binary)) % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and not any(r.rejected for r in out)
    odd = language_id.identify(table(spark, [None, "", "123 — !", "the " * 400_000]), model).collect()
    assert [r.lang_pred for r in odd][:3] == ["und"] * 3 and odd[3].lang_pred in model.languages and odd[0].score == 0
    assert {r.lang_pred for r in language_id.identify(table(spark, ["abc"]), language_id.fit([])).collect()} == {"und"}


def test_language_learns_from_null_and_repeated_ids(spark):
    said = {"en": "the of and that is for", "fr": "le la des est dans pour", "es": "el los que una por con"}
    for ids in (lambda i: None, lambda i: 4, lambda i: i):
        rng = random.Random(3)
        rows = [(ids(i), " ".join(rng.choices(said[y].split(), k=30)), y) for i in range(300) for y in said] + [(ids(1), "le la", "fr")] * 900 + [(1, None, "de"), (2, "123", "it")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.learn(df, per_language=100)
        assert {*said} <= set(model.languages)
        got = language_id.identify(df.where("length(text) > 50"), model).collect()
        assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
        far = language_id.identify(table(spark, ["zzq xkw vvj qqx " * 8]), model).collect()
        assert 0 <= far[0].score <= 1
    assert language_id.learn(df.limit(0)).languages == [] and language_id.identify(df.limit(0), model).count() == 0


def test_toxicity_learns_from_null_and_repeated_ids(spark):
    rng = random.Random(5)
    clean, bad = "the of and that is for one two".split(), "idiot scumbag moron".split()
    rows = [(i % 3 + 1, " ".join(rng.choices(clean, k=20) + ([rng.choice(bad)] if i % 3 == 0 else []))) for i in range(600)] + [(1, "the same text idiot")] * 900 + [(None, "idiot"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [r.doc_id for r in docs.where("crc32(cast(string(doc_id) as binary)) % 5 <> 0").select("doc_id").distinct().collect() if r.doc_id]
    assert {1} <= set(ids) and len(ids) > 1
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, per_label=60)
    got = toxicity.score(docs, model).collect()
    assert np.mean([r.predicted == int(any(b in (r.text or "") for b in bad)) for r in got]) > 0.97
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.learn(docs.limit(0), labels).landmarks == []
    long = toxicity.score(table(spark, ["the of " * 200_000, "the of " * 20]), model).collect()
    assert [r.predicted for r in long] == [0, 0]


def test_toxicity_held_out_accuracy_and_gaps(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(df, labels, per_label=900)
    held = df.where("crc32(cast(string(doc_id) as binary)) % 5 = 0").join(labels, "doc_id")
    out = toxicity.score(held, model).select("toxic", "predicted").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03
    said = ["thing of the idiot and", "thing of the i.d.i.o.t and", "thing of the i d i o t and", "thing of the idxiot and", "thing of the and", None, ""]
    got = [r.predicted for r in toxicity.score(table(spark, said), model).collect()]
    assert got == [1, 1, 1, 1, 0, 0, 0]
    one = toxicity.fit(["a", "b"], [0, 0])
    assert all(0 <= r.score < 0.5 for r in toxicity.score(table(spark, ["a", None]), one).collect())


def test_kernel_by_hand():
    from itertools import combinations

    def slow(s, t, n, d):
        spans = lambda x: [("".join(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), n)]
        return sum(d ** (p + q) for a, p in spans(s) for b, q in spans(t) if a == b)

    for s, t in (("idiot", "idxiot"), ("aaaa", "aaa"), ("clown", "crown"), ("ab", "abc")):
        a, b = toxicity._coded([s], 8), toxicity._coded([t], 8)
        assert abs(toxicity.kernel(a, b, 3, 0.6)[0] - slow(s, t, 3, 0.6)) < 1e-5


def test_kernel_gate_loses_no_pair():
    rng = random.Random(8)
    marks = ["blockhead", "worthless", "shithead", "scumbag", "parasite", "idiot", "aaa", "\u0434\u0443\u0440\u0430\u043a"]
    strings = ["", "a", "blckhad", "wrthlss", "shthad", "scmbg", "scumb", "blockhe", "parasi", *marks]
    for word in marks:
        strings += ["".join(c for c in word if rng.random() > 0.35) + rng.choice(["", "x", "qed"]) for _ in range(40)]
        strings += ["".join(rng.choice(word + "xyz") for _ in range(rng.randrange(40))) for _ in range(40)]
    model = toxicity.ToxicityModel(landmarks=marks)
    (i, j, v), (x, y, w) = (toxicity.similarities(strings, model, gate=gate) for gate in (True, False))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(x.tolist(), y.tolist(), strict=True)) and np.allclose(v, w, atol=1e-5)
    assert {(strings[a], marks[b]) for a, b in zip(i, j, strict=True)} >= {("blckhad", "blockhead"), ("wrthlss", "worthless"), ("scmbg", "scumbag"), ("parasi", "parasite")}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA)
        assert out.columns == want, name
        assert 0 < out.count() <= docs.count()
    odd = table(spark, [None, "", "a b c d e f", "a b c d e f", "the and of"])
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, odd, DATA).columns == odd.columns, name
    clean = "thing of the and one two three four five six "
    rows = [(None, clean + "a b c d"), (None, clean + "e f g h i j"), (4, clean + "k l m n o"), (4, clean + "k l m n o p q r s t")]
    odd = spark.createDataFrame([(*r, "en", "s", "x") for r in rows], "doc_id long, text string, lang string, source string, prob string")
    for name in ("toxicity", "benchmark_decontamination"):
        assert sorted(map(str, dict(corpus_pipeline.STAGES)[name](spark, odd, DATA).collect())) == sorted(map(str, odd.collect())), name
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, odd.limit(0), DATA).count() == 0, name


def test_sketches_pass_every_linked_pair():
    rng = np.random.default_rng(6)
    for n in [*range(2, 60), 120, 333, 900, 4000]:
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 9, dtype=np.uint64))
        rng.shuffle(pool)
        gone, new = n // 9, n // 12
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[gone:n], pool[n : n + new]]))
        if len(b) and jaccard_join.linked(n - gone, len(a), len(b)):
            both = jaccard_join.common_sketches([jaccard_join.sketch(a), jaccard_join.sketch(b)])
            assert len(jaccard_join.may_link(both, np.array([len(a), len(b)]), 0, np.array([1]), 80)) == 1, n
            other = np.sort(pool[-n:])
            far = jaccard_join.common_sketches([jaccard_join.sketch(a), jaccard_join.sketch(other)])
            assert n < 40 or not len(jaccard_join.may_link(far, np.array([n, n]), 0, np.array([1]), 80)), n
