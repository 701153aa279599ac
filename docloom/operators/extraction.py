"""Extraction from texts in three passes: core entities with facts, relations among them, further entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

#: Where a sentence ends, in any regular expression dialect.
SENTENCE = r"[.!?][ \n]"


def any_of(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def _kind(name: Column, patterns: dict[str, str]) -> Column:
    """The first kind whose pattern is all of name."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(patterns.items()):
        out = F.when(name.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _entities(text: Column, patterns: dict[str, str], gate: str | None = None) -> Column:
    """(kind, name) of each match, in the order of the text; a text without the gate's pattern isn't searched."""
    found = F.regexp_extract_all(text, F.lit(any_of(patterns)), F.lit(0))
    if gate is not None:
        found = F.when(text.rlike(gate), found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda v: F.struct(_kind(v, patterns).alias("kind"), v.alias("name")))


def _found(rows: Column, what: str, kind, name, target=lambda x: F.lit(None).cast("string")) -> Column:
    return F.transform(rows, lambda x: F.struct(F.lit(what).alias("what"), kind(x).alias("kind"), name(x).alias("name"), target(x).alias("target")))


def three_passes(
    docs: DataFrame, core: dict[str, str], relations: dict[tuple[str, str], str], extended: dict[str, str], key: str = "doc_id", text: str = "text", least: int = 20, facts: int = 3, gate: str | None = None
) -> DataFrame:
    """(key, what, kind, name, target, times): what each text says, by patterns; whole texts are read, once.

    ``core``: matches of the first patterns (what = core), and the first ``facts`` sentences that hold any (fact).
    ``relations``: an entity and the next one of its sentence are related as their kinds say (relation, from name to
    target); so a text of n entities has fewer than n relations, not pairs. ``extended``: matches of further patterns
    (extended), looked for in sentences too. A match is of the first kind that fits. A text of fewer than ``least``
    characters without the blanks around it, or null, says nothing but a warning. Rows of one key count together, those of
    the null key too; facts are those of each row. ``gate``: a pattern that is in each sentence with a core match, to spare
    the others the search. Patterns with a bound on what stands before a rare character keep long junk linear.
    """
    rows = docs.select(F.col(key), F.coalesce(docs[text], F.lit("")).alias("__text"))
    long = F.length(strip(F.col("__text"))) >= least
    said = rows.withColumn("__s", F.transform(F.split("__text", SENTENCE, -1), lambda s: F.struct(s.alias("s"), _entities(s, core, gate).alias("e"), _entities(s, extended).alias("x"))))

    def related(e: Column) -> Column:
        return F.zip_with(e, F.slice(e, 2, F.greatest(F.size(e), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))  # behind the last one is null

    def relation(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for (a, b), kind in relations.items():
            out = F.when((p["a"]["kind"] == a) & (p["b"]["kind"] == b), kind).otherwise(out)
        return out

    s = F.col("__s")
    entity = (lambda x: x["kind"], lambda x: x["name"])
    pairs = F.filter(F.flatten(F.transform(s, lambda x: F.transform(related(x["e"]), lambda p: F.struct(relation(p).alias("kind"), p["a"]["name"].alias("name"), p["b"]["name"].alias("target"))))), lambda p: p["kind"].isNotNull())
    held = F.slice(F.filter(s, lambda x: F.size(x["e"]) > 0), 1, facts)
    none = lambda x: F.lit(None).cast("string")
    everything = F.concat(
        _found(F.flatten(F.transform(s, lambda x: x["e"])), "core", *entity),
        _found(held, "fact", none, lambda x: x["s"]),
        _found(pairs, "relation", *entity, lambda x: x["target"]),
        _found(F.flatten(F.transform(s, lambda x: x["x"])), "extended", *entity),
    )
    warning = F.array(F.struct(F.lit("warning").alias("what"), none(None).alias("kind"), F.lit("too short").alias("name"), none(None).alias("target")))
    each = said.select(key, F.explode(F.when(long, everything).otherwise(warning)).alias("__f"))
    return each.groupBy(key, *(F.col(f"__f.{c}").alias(c) for c in ("what", "kind", "name", "target"))).agg(F.count("*").alias("times"))
