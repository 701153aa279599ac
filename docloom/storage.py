"""Staged tables in the cluster's shared folder: how docloom cuts lineage.

A staged table is a plain Parquet folder under ``spark.checkpoint.dir``. Every executor can read it again, so a lost
executor costs a re-run of the tasks it held and never the stages before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SET_HERE = "docloom.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session gets a new
    temporary one; executors elsewhere couldn't read that, so any other session is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SET_HERE, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SET_HERE, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def broadcast_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most ``most`` rows (counted up to there); otherwise as it is."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df for heavy work in each task: a scan of fewer partitions than the session has cores (a small table, a file that
    can't be split) is dealt out to all of them; a larger one is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """df, of so many rows, dealt by keys to tasks of some ``most`` rows. The number is fixed, so that Spark doesn't merge
    tasks again by their compressed bytes: what a task sorts or groups doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
