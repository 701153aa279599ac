"""The corpus pipeline: each stage filters or samples what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard_join, language_id, toxicity
from docloom.llm._split import free_name
from docloom.llm.queries import sampled
from docloom.storage import new_path, read_table, unstage


def _plain(docs: DataFrame, added: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns that an operator would replace under other names, and how to name them back."""
    back, taken = {}, {a.lower() for a in added}
    for c in docs.columns:
        if c.lower() in taken:
            back[free_name([*docs.columns, *added, *back], f"_{c}")] = c
    for new, old in back.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, back


def _scored(docs: DataFrame, operator, model, added: list[str], keep: F.Column) -> DataFrame:
    plain, back = _plain(docs, added)
    out = operator(plain, model).where(keep)
    return out.select(*[F.col(next((n for n, o in back.items() if o == c), c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine, taught by the labels of these documents, predicts as not toxic."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score, model, ["score", "predicted"], F.col("predicted") == 0)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with at least the calibrated confidence."""
    model = language_id.learn(docs)
    return _scored(docs, language_id.identify, model, ["lang_pred", "score", "rejected"], ~F.col("rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that of the smallest doc_id."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked probabilities, all columns; each row is judged in place."""
    return sampled(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", sample_to_weights),
]

#: SQL can't express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, all columns.

    Each stage is written as a table in the shared folder, and the table before it is removed once that is done, so two
    copies of what is left are held at most. Rows are judged one by one where that is the stage's way: null and repeated
    ids, null and empty texts (a null text has no language, so the second stage drops it) and an empty table are what each
    stage's operator says; copies of a row leave together or, as near duplicates, but for one.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        unstage(docs)  # nothing but tables of this library's own is removed
        docs = spark.read.parquet(path)
    return docs
