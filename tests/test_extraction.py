"""Extraction in three passes, against a brute-force version in Python; services that fail on some values."""

import re
from collections import Counter

import pandas as pd

from docloom.adapters import apply_or
from docloom.operators.extraction import three_passes

CORE = {"email": "[a-z]{1,64}@[a-z]+[.][a-z]{2,}", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "number": "[0-9]{4,}"}
RELATIONS = {("email", "number"): "REACHED_AT", ("number", "number"): "LISTED_WITH"}
EXTENDED = {"acronym": "[A-Z]{3,}"}
COLUMNS = ("doc_id", "what", "kind", "name", "target", "times")
TEXTS = [
    (1, "Write to a@b.org or 12345 today. On 2024-01-02 we had 4444 and 5555 and 4444 of the ABC. Then nothing."),
    (2, "Write to a@b.org or 12345 today! Again a@b.org, 12345. And 1111. And 2222. And 3333."),
    (3, None),
    (4, ""),
    (5, "   \n  12345 \t "),
    (6, "exactly 20 letters 1"),
    (7, "XYZ " * 30_000),
    (8, "a" * 200_000),
    (None, "The row has no key but 9999."),
    (None, "The row has no key but 9999."),
]


def by_hand(rows):
    out = Counter()
    first = lambda patterns, v: next(k for k, p in patterns.items() if re.fullmatch(p, v))
    for key, text in rows:
        if len((text or "").strip(" \t\n\r\f")) < 20:
            out[key, "warning", None, "too short", None] += 1
            continue
        facts = 0
        for s in re.split("[.!?][ \n]", text):
            found = re.findall("|".join(CORE.values()), s)
            for v in found:
                out[key, "core", first(CORE, v), v, None] += 1
            if found and facts < 3:
                out[key, "fact", None, s, None] += 1
                facts += 1
            for a, b in zip(found, found[1:], strict=False):
                if kind := RELATIONS.get((first(CORE, a), first(CORE, b))):
                    out[key, "relation", kind, a, b] += 1
            for v in re.findall("|".join(EXTENDED.values()), s):
                out[key, "extended", first(EXTENDED, v), v, None] += 1
    return out


def test_three_passes_equal_a_search_by_hand(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS], "doc_id long, text string, name string, times int")
    for gate in (None, "[0-9@]"):
        rows = three_passes(docs, CORE, RELATIONS, EXTENDED, gate=gate).collect()
        assert {tuple(r[c] for c in COLUMNS[:5]): r["times"] for r in rows} == by_hand(TEXTS)
        assert len(rows) == len(by_hand(TEXTS))


def test_three_passes_of_no_rows_and_no_relations(spark):
    docs = spark.createDataFrame([(1, TEXTS[0][1])], "doc_id long, text string")
    assert three_passes(docs.limit(0), CORE, RELATIONS, EXTENDED).count() == 0
    assert three_passes(docs, CORE, {}, EXTENDED).where("what = 'relation'").count() == 0


def test_a_failing_value_costs_no_other_its_result(spark):
    def service(texts: pd.Series) -> pd.Series:
        if texts.isna().any() or (texts == "bad").any():
            raise ValueError
        return pd.Series([[float(len(t))] for t in texts])

    said = ["bad" if i % 7 == 3 else None if i % 11 == 5 else "x" * i for i in range(100)]
    rows = spark.createDataFrame(list(enumerate(said)), "i long, text string").coalesce(1)
    for group in (1, 10, 1000):
        got = {r["i"]: r["v"] for r in apply_or(rows, "text", "v", service, "array<double>", [0.0], group).collect()}
        assert got == {i: [0.0] if t in (None, "bad") else [float(len(t))] for i, t in enumerate(said)}
    assert apply_or(rows.limit(0), "text", "v", service, "array<double>", [0.0]).count() == 0
