"""The operators as registered queries over whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, chat, decontaminate, exact_dedup, jaccard_join, language_id, lm_scoring, merkle, mixing, periodic_runs, token_counts, toxicity, warc
from docloom.llm._split import remainder
from docloom.storage import read_table

DIMS = ["source", "lang", "topic"]
POWER = {"source": 0.7, "lang": 0.5, "topic": 0.7}
SHARE, ROUNDS, SEED = 0.5, 30, 7
SPACED = r"[^\x20\x09-\x0D]+"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def held_out(modulus: int) -> Column:
    return (remainder(F.col("doc_id"), modulus) == 0).alias("held_out")


def topic() -> Column:
    """The form of a text as its topic: licence notes, tables, prose; none for a null text."""
    return F.when(F.col("text").contains("icense"), "licence").when(F.col("text").contains(" | "), "table").when(F.col("text").isNotNull(), "prose")


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0))


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs.withColumn("topic", topic()), DIMS, tokens(), seed=SEED, power=POWER, share=SHARE, rounds=ROUNDS)


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of docs that op5 samples, all columns."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic()}
    return mixing.sample(docs, dims, tokens(), seed=SEED, power=POWER, share=SHARE, rounds=ROUNDS)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(5), "lang_pred", "score", "rejected")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))
    return records.select(
        F.col("source_id").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
        "block_digest", "payload_digest", F.decode("block", "utf-8").alias("block"),
    )  # fmt: skip


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *DIMS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(5), "score", "predicted")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a document whose text had its A-Z lower-cased: where 5 divides the crc32 of its id; null for others."""
    text = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [text if c == "text" else docs[c] for c in LEAF]
    return F.when(remainder(docs["doc_id"], 5) == 0, merkle.leaf_hash(fields))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    proofs = merkle.build(docs, LEAF, carried={"tampered": tampered(docs)}).proofs()
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "hash"), F.col("proof")))
    return folded.select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )  # fmt: skip


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


_TURNS = """WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations),
coded AS (SELECT *, md5(coalesce('r' || role, '') || chr(31) || coalesce('t' || text, '')) AS said FROM turns),
whole AS (SELECT conv_id, count(*) AS n, list(said ORDER BY place) AS path FROM coded GROUP BY conv_id),
prefix AS (SELECT DISTINCT w.path[1:k.i] AS path FROM whole w, LATERAL (SELECT unnest(range(1, w.n)) AS i) k),
kept AS (SELECT path, min(conv_id) AS conv_id, max(n) AS n FROM whole GROUP BY path)
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns,
  string_agg('<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.place) AS rendered
FROM kept k JOIN turns t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
WHERE k.path NOT IN (SELECT path FROM prefix) GROUP BY k.conv_id, k.n"""


def _raked_sql() -> str:
    """Documents' sampling probabilities: a common table expression for each raking step."""
    steps = [
        r"sized AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(CASE WHEN contains(text, 'icense') THEN 'licence' WHEN contains(text, ' | ') THEN 'table' WHEN text IS NOT NULL THEN 'prose' END, '(none)') AS topic, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM sized GROUP BY ALL)",
        "totals AS MATERIALIZED (SELECT sum(tokens) AS total FROM cells)",
    ]
    for d in DIMS:
        steps.append(f"raised_{d} AS (SELECT {d}, pow(sum(tokens), {POWER[d]}) AS p FROM cells GROUP BY {d} HAVING sum(tokens) > 0)")
        steps.append(f"aim_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS target FROM raised_{d})")
    before, n = "(SELECT *, CAST(1 AS DOUBLE) AS weight FROM cells)", 0
    for _ in range(ROUNDS):
        for d in DIMS:
            n += 1
            steps.append(f"w{n} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN h.held > 0 THEN c.weight * coalesce(a.target, 0) * (SELECT total FROM totals) / h.held ELSE 0 END AS weight FROM {before} c JOIN (SELECT {d}, sum(tokens * weight) AS held FROM {before} x GROUP BY {d}) h USING ({d}) LEFT JOIN aim_{d} a USING ({d}))")
            before = f"w{n}"
    steps += [
        f"ranked AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure, sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {before} WHERE weight > 0)",
        f"factor AS (SELECT coalesce(greatest(0, arg_max(({SHARE} * total - sure) / rest, weight) FILTER (({SHARE} * total - sure) / rest * weight <= 1)), 1 / min(weight)) AS f FROM ranked, totals)",
        f"priced AS (SELECT s.*, w.weight, least(1.0, w.weight * f) AS prob FROM sized s JOIN {before} w USING (source, lang, topic), factor)",
    ]
    return "WITH " + ",\n".join(steps)


_SAMPLED = f"CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < prob"

_JACCARD = r"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)"""

_CONTAMINATED = r"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
runs AS MATERIALIZED (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m)),
hit AS MATERIALIZED (SELECT runs.doc_id, win.item_id, runs.i, runs.m FROM runs JOIN win ON runs.m = win.m AND runs.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named i USING (doc_id)"""


def _crc32_sql(value: str) -> str:
    """Unsigned crc32 of a string of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({value}) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substr({value}, i, 1)) >> b) & 1)))"
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}))"


def _leaf_sql(fields: dict[str, str]) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':') || CAST({x} AS VARCHAR), '-')" for x in fields.values()) + "))"


def _levels_sql(name: str, leaves: str) -> str:
    """name(tree, level, i, h): the nodes of all trees of leaves (tree, i, h); siblings are nodes of one tree, level and i // 16."""
    return f"""{name}(tree, level, i, h) AS (SELECT tree, 0, i, h FROM {leaves} UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS held FROM {name}) WHERE held > 1 GROUP BY tree, level, i // 16)"""


_PLAIN = {c: c for c in LEAF}
_LOWERED = _PLAIN | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}
#: Proofs are folded step by step in one recursion: through the source's tree, then from its root through the last tree.
_MERKLE = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce('s' || source, '') AS tree, {_leaf_sql(_PLAIN)} AS h,
  CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(_LOWERED)} END AS tampered FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_levels_sql("low", "placed")},
low_nodes AS MATERIALIZED (SELECT * FROM low),
subroots AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, h FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS top FROM low_nodes) WHERE level = top),
{_levels_sql("high", "subroots")},
nodes AS MATERIALIZED (SELECT 0 AS part, * FROM low_nodes UNION ALL SELECT 1, * FROM high),
steps AS MATERIALIZED (SELECT a.part, a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN (SELECT part, tree, max(level) AS top FROM nodes GROUP BY part, tree) t ON t.part = a.part AND t.tree = a.tree AND a.level < t.top
  JOIN nodes b ON b.part = a.part AND b.tree = a.tree AND b.level = a.level AND b.i // 16 = a.i // 16 GROUP BY ALL),
walk(row, part, tree, name, level, i, proof, folded, going) AS (
  SELECT row, 0, tree, tree, 0, i, '', coalesce(tampered, h), true FROM placed UNION ALL
  SELECT w.row, CASE WHEN s.tree IS NULL THEN w.part + 1 ELSE w.part END, CASE WHEN s.tree IS NULL THEN '' ELSE w.tree END, w.name,
    CASE WHEN s.tree IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN s.tree IS NULL THEN r.i ELSE w.i // 16 END,
    w.proof || coalesce(s.before || s.after, ''), CASE WHEN s.tree IS NULL THEN w.folded ELSE sha256(s.before || w.folded || s.after) END, w.part = 0 OR s.tree IS NOT NULL
  FROM walk w LEFT JOIN steps s ON s.part = w.part AND s.tree = w.tree AND s.level = w.level AND s.i = w.i LEFT JOIN subroots r ON r.name = w.name WHERE w.going)
SELECT p.doc_id, p.h AS leaf, r.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.h AS verified
FROM placed p JOIN (SELECT * FROM walk WHERE NOT going) w ON w.row = p.row JOIN subroots r ON r.name = p.tree, (SELECT h FROM high ORDER BY level DESC LIMIT 1) t"""

_COPIES = r"""WITH plain AS (SELECT row_number() OVER () AS row, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM plain
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM ranked"""

#: Runs are the stretches in which words q apart agree, for each q; of stretches with the same ends the smallest q is the period.
_RUNS = f"""WITH said AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
rule AS (SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS made, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM said),
d AS MATERIALIZED (SELECT row, doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE ws END AS ws FROM rule),
w AS MATERIALIZED (SELECT row, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM d),
pairs AS (SELECT a.row, a.i, b.i - a.i AS q FROM w a JOIN w b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
ranked AS (SELECT a.row, a.start, a.length, a.period, count(b.row) AS ahead FROM runs a LEFT JOIN runs b ON a.row = b.row AND
  (b.length * a.period > a.length * b.period OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period)) GROUP BY ALL),
listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT d.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(r.start AS BIGINT) AS start, CAST(r.length AS BIGINT) AS length, CAST(r.period AS BIGINT) AS period,
  CAST(1000 * r.length // r.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.words, '')) AS collapsed_sha256
FROM d LEFT JOIN listed l USING (row) LEFT JOIN (SELECT * FROM ranked WHERE ahead = 0) r USING (row) LEFT JOIN kept k USING (row)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": _JACCARD,
        "op3_chat_formatting": _TURNS,
        "op5_mixing": f"{_raked_sql()}\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob, {_SAMPLED} AS sampled FROM priced",
        "op7_benchmark_decontamination": _CONTAMINATED,
        "op11_merkle_manifest": _MERKLE,
        "op12_exact_dedup": _COPIES,
        "op13_periodic_runs": _RUNS,
    }
