"""Keywords per document, counted inside each document's own row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as X


def keyword_counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, word, n, first_rank)``: every keyword of every document."""
    counted = X.exploded(documents, [key], X.keyword_table(text), "position", "k")
    return counted.select(key, "k.word", "k.n", "k.first_rank")


def keywords_topk(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = V.DEFAULT_KEYWORDS
) -> DataFrame:
    """``(key, rank, word, n)``: most frequent first, ties by first appearance."""
    ranked = X.exploded(documents, [key], X.top_keywords(text, limit), "position", "k")
    return ranked.select(key, (F.col("position") + 1).alias("rank"), "k.word", "k.n")
