"""Chat logs: collapse cumulative snapshots, then render what is left. DataFrame operations only.

A service that logs a conversation after every turn leaves many conversations of which each is a prefix of a longer one.
A turn's hash covers its place, role and text; the exclusive or of the hashes so far is the rolling hash of the prefix.
As places are hashed in, equal rolling hashes at equal lengths mean equal prefixes (two 64-bit hashes with different
seeds; a chance of 2**-128 a pair). A conversation whose whole hash is the prefix hash of a longer one is dropped by an
anti-join, and of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each turn: c_id, place (from 1), h1 and h2 (rolling hash up to here), c_role, c_text, last."""
    turns = conversations.select(
        F.col("conv_id").alias("c_id"), F.col("turn").alias("c_turn"), F.col("role").alias("c_role"), F.col("text").alias("c_text")
    )
    order = Window.partitionBy("c_id").orderBy(F.asc_nulls_first("c_turn"), F.asc_nulls_first("c_role"), F.asc_nulls_first("c_text"))
    placed = turns.withColumn("place", F.row_number().over(order).cast("long")).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    said = [F.col("c_role").isNull(), F.coalesce("c_role", F.lit("")), F.col("c_text").isNull(), F.coalesce("c_text", F.lit(""))]
    so_far = Window.partitionBy("c_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.withColumn("t1", F.xxhash64(F.lit(1), "place", *said)).withColumn("t2", F.xxhash64(F.lit(2), "place", *said))
    return hashed.select("c_id", "place", F.bit_xor("t1").over(so_far).alias("h1"), F.bit_xor("t2").over(so_far).alias("h2"), "c_role", "c_text", "last")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of conversations that prefix no longer one; of equal ones, that of the smallest conv_id.

    A turn's place follows turn, then role, then text, nulls first, so repeated turn numbers and rows have one order.
    Turns without conv_id form one conversation. A null role or text differs from an empty one. An empty table gives no
    rows.
    """
    rolled = prefixes(conversations).drop("c_role", "c_text")
    whole = rolled.where("last").groupBy("place", "h1", "h2").agg(F.min("c_id").alias("conv_id"))
    longer = rolled.where(~F.col("last")).select(F.col("place").alias("p"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    alone = whole.join(longer, (F.col("place") == F.col("p")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_anti")
    return alone.select("conv_id", F.col("place").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation: "<|role|>", text and "<|end|>" a turn.

    A null role is rendered as "unknown", a null text as nothing. Extra columns are ignored. For rules on nulls, ties,
    repeated rows and empty tables see ``maximal``.
    """
    kept = maximal(conversations)
    turns = conversations.select(F.col("conv_id").alias("c_id"), F.col("turn").alias("c_turn"), F.col("role").alias("c_role"), F.col("text").alias("c_text"))
    mine = turns.join(kept, F.col("c_id").eqNullSafe(F.col("conv_id")))
    said = F.sort_array(F.collect_list(F.struct("c_turn", "c_role", "c_text")))
    one = F.transform(said, lambda t: F.concat(F.lit("<|"), F.coalesce(t["c_role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["c_text"], F.lit("")), F.lit("\n<|end|>\n")))
    return mine.groupBy("conv_id", "n_turns").agg(F.array_join(one, "").alias("rendered"))
