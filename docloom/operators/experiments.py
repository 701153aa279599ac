"""A/B tests over long-form samples (variant, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import md5_mod100


def variant_means(samples: DataFrame) -> DataFrame:
    return samples.groupBy("variant", "metric").agg(F.count("*").alias("samples"), F.avg("value").alias("mean"))


def winners(samples: DataFrame) -> DataFrame:
    """Each metric's variant of the highest mean (to four places); the first of equals."""
    means = variant_means(samples).select("metric", "variant", F.round("mean", 4).alias("mean"))
    return means.groupBy("metric").agg(F.max_by("variant", F.struct("mean", -F.col("variant"))).alias("winner"))


def significance(samples: DataFrame, least_samples: int = 30, least_spread: float = 0.05) -> DataFrame:
    means = variant_means(samples).select("metric", "samples", F.round("mean", 4).alias("mean"))
    spread = F.max("mean") - F.min("mean")
    return means.groupBy("metric").agg(
        F.count("*").alias("variants"), F.min("samples").alias("fewest"), F.round(spread, 4).alias("spread"),
        ((F.count("*") >= 2) & (F.min("samples") >= least_samples) & (spread > least_spread)).alias("significant"),
    )


def assign(users: DataFrame, test_id: str, shares: list[tuple[str, float]]) -> DataFrame:
    """users (user_id) with bucket and variant: the first whose cumulative share reaches the bucket, else the last.

    Shares are scaled to 100.
    """
    total, cumulative, so_far = sum(s for _, s in shares), [], 0.0
    for name, s in shares:
        so_far += 100.0 * s / total
        cumulative.append((name, so_far))
    variant = F.lit(cumulative[-1][0])
    for name, bound in reversed(cumulative):
        variant = F.when(F.col("bucket") <= bound, name).otherwise(variant)
    return users.withColumn("bucket", md5_mod100(F.concat(F.lit(f"{test_id}-"), F.col("user_id").cast("string")))).withColumn("variant", variant)
