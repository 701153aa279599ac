"""Automatic quality metrics of question and answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def automatic(pairs: DataFrame, query: str, response: str) -> DataFrame:
    """Relevance, coherence, fluency, completeness by words and lengths; faithfulness and hallucination are constants."""
    split = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    q, r = F.array_distinct(split(query)), F.array_distinct(split(response))
    sentences = F.size(F.filter(F.split(response, r"\."), lambda x: F.trim(x) != ""))
    n_words = F.size(F.filter(F.split(response, " "), lambda x: x != ""))
    one = F.lit(1.0)
    return pairs.withColumns(
        {
            "relevance": F.least(one, 2.0 * F.size(F.array_intersect(q, r)) / F.greatest(F.lit(1), F.size(q))),
            "coherence": F.when(sentences == 0, 0.0).when(sentences == 1, 0.5).otherwise(F.least(one, sentences / 10.0)),
            "fluency": F.least(one, n_words / 20.0),
            "completeness": F.least(one, F.length(response) / F.greatest(F.lit(1), F.length(query)) / 5.0),
            "faithfulness": F.lit(0.7),
            "hallucination_rate": F.lit(0.2),
        }
    )
