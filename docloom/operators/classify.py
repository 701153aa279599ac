"""Document classification: weighted rules, and a learned model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import spread, stage

_PLAIN = re.compile(r"\([^()|]+(?:\|[^()|]+)*\)")


def without_cyrillic(pattern: str) -> str | None:
    """A pattern that finds the same in texts without a Cyrillic letter; None if it can't find anything there.

    Of a plain list of alternatives those go that hold such a letter outside of brackets and not as an option: no letter of
    another script equals it when case is ignored. Any other pattern stays as it is.
    """
    if not _PLAIN.fullmatch(pattern) or r"\|" in pattern or r"\[" in pattern:
        return pattern
    kept = [a for a in pattern[1:-1].split("|") if not re.search(r"[\u0400-\u04FF](?![?*{])", re.sub(r"\[[^\]]*\]", "#", a))]
    return f"({'|'.join(kept)})" if kept else None


def by_rules(docs: DataFrame, rules: list[tuple[str, str, float]], text: str = "text", tag_over: float = 0.5, read: int | None = None) -> DataFrame:
    """docs with class, confidence and tagged. All rules are tested in one pass over a row; nothing is exploded.

    Patterns ignore case, in every script. ``read``: look at the first so many characters only. Whether a text has a Cyrillic
    letter is looked up once; patterns that need one aren't tried on others.
    """
    docs = spread(docs)
    seen = F.col(text) if read is None else F.substring(text, 1, read)
    docs, names = docs.withColumn("__cyrillic", seen.rlike(r"\p{IsCyrillic}")), docs.columns
    sums: dict = {}
    for kind, pattern, weight in rules:
        met = F.col("__cyrillic") & seen.rlike(f"(?iu){pattern}")
        if (other := without_cyrillic(pattern)) is not None:
            met = F.when(F.col("__cyrillic"), seen.rlike(f"(?iu){pattern}")).otherwise(seen.rlike(f"(?iu){other}"))
        sums[kind] = sums.get(kind, F.lit(0.0)) + F.when(met, weight).otherwise(0.0)
    scores = F.array(*[F.struct(F.round(s, 6).alias("score"), F.lit(-i).alias("first"), F.lit(k).alias("class")) for i, (k, s) in enumerate(sums.items())])
    best = F.array_max(scores)
    out = docs.withColumn("__best", best)
    none = F.coalesce(F.col("__best.score"), F.lit(0.0)) == 0
    return out.select(
        *names, F.when(none, "other").otherwise(F.col("__best.class")).alias("class"),
        F.least(F.lit(1.0), F.coalesce("__best.score", F.lit(0.0))).alias("confidence"), (F.coalesce("__best.score", F.lit(0.0)) > tag_over).alias("tagged"),
    )


def _term_counts(text: str, features: int):
    """Words and word pairs of a text, counted in hashed places: column tf. Nothing here is fitted."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    return PipelineModel([
        RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"\s+"),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        HashingTF(inputCol="w1", outputCol="t1", numFeatures=features),
        HashingTF(inputCol="w2", outputCol="t2", numFeatures=features),
        VectorAssembler(inputCols=["t1", "t2"], outputCol="tf"),
    ])


def _fitted(counted: DataFrame, label: str):
    """Weights of terms and a logistic regression on rows with tf and a label; each is read some times."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    if len(counted.limit(5).collect()) < 5:
        raise ValueError("at least five labelled documents are needed")
    return Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, maxIter=20, regParam=0.01)]).fit(counted)


def train_tfidf(docs: DataFrame, label: str, text: str = "text", features: int = 5000):
    """A fitted MLlib pipeline: words and word pairs, TF-IDF, multinomial logistic regression. Needs five rows or more."""
    from pyspark.ml import PipelineModel

    terms = _term_counts(text, features)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    return PipelineModel([terms, _fitted(stage(terms.transform(spread(rows)).select(label, "tf"), "terms"), label)])


def by_tfidf(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", features: int = 5000) -> DataFrame:
    """key and prediction for each row of docs, by what labels (key, label) teach: train_tfidf, applied to the documents
    themselves. Each text is cut to terms once; fitting and prediction read the staged counts. A null text has no terms and
    teaches nothing."""
    plain = spread(docs.select(key, F.coalesce(text, F.lit("")).alias(text), F.col(text).isNotNull().alias("__said")))
    counted = stage(_term_counts(text, features).transform(plain).select(key, "__said", "tf"), "terms")
    taught = counted.where("__said").join(labels.select(key, label).where(F.col(label).isNotNull()), key).select(label, "tf")
    return _fitted(taught, label).transform(counted).select(key, "prediction")
