"""Substring search as an equi-join: an index of the one to three characters that names hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.latest import look_up
from docloom.storage import stage

GRAM = 3


def grams(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of the given lengths; the empty one is in every text."""

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, n))

    return F.array_distinct(F.concat(*[of(n) if n else F.array(F.lit("")) for n in lengths]))


@dataclass
class SubstringIndex:
    """entries: (gram, name), staged; sizes: (gram, n), the number of names that hold a gram."""

    entries: DataFrame
    sizes: DataFrame

    @classmethod
    def build(cls, names: DataFrame, name: str = "name") -> SubstringIndex:
        """The index of the distinct names; null names are in no gram."""
        distinct = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
        entries = stage(distinct.select(F.explode(grams(F.col("name"), list(range(GRAM + 1)))).alias("gram"), "name"), "grams")
        return cls(entries, entries.groupBy("gram").agg(F.count("*").alias("n")))

    def matches(self, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
        """(columns of phrases, name): every name that contains a phrase, as a scan would find them; case counts.

        A phrase is looked up by the rarest of its grams of three characters, or by itself where it is shorter, and what is
        found is checked. A phrase with a gram that no name holds finds nothing. An empty phrase is in every name.
        """
        columns = phrases.columns
        p = phrases.select(F.struct(*columns).alias("asked"), F.col(phrase).alias("said")).where("said IS NOT NULL")
        n = F.length("said")
        own = F.when(n >= GRAM, grams(F.col("said"), [GRAM])).otherwise(F.array("said"))
        said = p.select("said").distinct().select("said", F.explode(own).alias("gram"))
        known = said.join(self.sizes, "gram", "left").groupBy("said").agg(F.min_by("gram", "n").alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("found"))
        keys = stage(known.where("found").select("said", "gram"), "asked")
        hit = look_up(self.entries, keys, ["gram"], "name").where(F.expr("contains(name, said)")).select("said", "name")
        return p.join(hit, "said").select("asked.*", "name")
