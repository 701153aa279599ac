"""Sinks: merged tables, append-only logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.latest import last_n, upsert


def merge_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], version: int) -> str:
    """The table at path/v{version}: the version before merged with new, latest wins. Readers keep the old version."""
    old = f"{path}/v{version - 1}"
    rows = upsert(spark.read.parquet(old), new, keys, order) if version > 1 else last_n(new, keys, order, 1)
    out = f"{path}/v{version}"
    rows.write.mode("overwrite").parquet(out)
    return out


def append_log(events: DataFrame, path: str) -> None:
    """Audit and process logs: JSON lines, appended."""
    events.write.mode("append").json(path)


def export_annotations(scores: DataFrame, path: str) -> None:
    """Long-form scores (response_id, metric, score) as CSV with a column for each metric."""
    wide = scores.groupBy("response_id").pivot("metric").agg(F.first("score"))
    wide.write.mode("overwrite").option("header", True).csv(path)


def export_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def store_by_prefix(files: DataFrame, path: str, id_column: str = "document_id") -> None:
    """Content-addressed storage: partitioned by the first two characters of the id."""
    files.withColumn("prefix", F.substring(id_column, 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def insert_notifications(rows: DataFrame, path: str) -> None:
    """Notifications (user_id, kind, message), appended as unread; an id names user, kind, message and time."""
    at = F.current_timestamp()
    new = rows.select(F.sha2(F.concat_ws("|", "user_id", "kind", "message", at.cast("string")), 256).alias("id"), "user_id", "kind", "message", F.lit(False).alias("read"), at.alias("created_at"))
    new.write.mode("append").parquet(path)
