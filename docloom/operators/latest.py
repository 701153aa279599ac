"""Mutable state on append-only tables: latest wins, last N, deletes by anti-join, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import broadcast_small


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order given; Spark limits groups before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= n).drop("__place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old and new together, each key's first row in the order given; columns that one lacks are null."""
    return last_n(old.unionByName(new, allowMissingColumns=True), keys, order, 1)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among the gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def first_per(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row for each value of the key expressions: the first in the order given."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(by)).where("__place = 1").drop("__place")


def look_up(rows: DataFrame, found: DataFrame, keys: list[str], spread: str, salts: int = 16, most: int = 100_000) -> DataFrame:
    """rows joined with what found says of their keys, one row a key; a key may hold a third of rows.

    A small table (counted) is broadcast. Otherwise rows are dealt by key and a hash of spread, and found is repeated for
    each of the ``salts``, so a key's rows meet in that many tasks.
    """
    if (small := broadcast_small(found, most)) is not found:
        return rows.join(small, keys)
    return salted(rows, found, keys, spread, salts)


def salted(rows: DataFrame, found: DataFrame, keys: list[str], spread: str, salts: int = 16) -> DataFrame:
    """rows joined with found, a key's rows in ``salts`` tasks, each with all that found has of the key."""
    copies = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [*keys, "__salt"]).drop("__salt")
