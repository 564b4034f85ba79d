"""The two headline plans: article selection, and pages to run statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import dates, html as H, text as X
from foliolens.operators import barrier, markup as M, relational as R, stats
from foliolens.sources import adapters as A, tables as T


def filter_sort_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Per author: the ten latest non-premium articles in a date range with wanted tags."""
    articles = A.articles(T.scan_table(spark, folder, "documents"), T.scan_table(spark, folder, "labels"))
    chosen = R.filter_sort_limit(
        articles, tags=["EN", "fr", "src7"], start=datetime(2024, 1, 3),
        end=datetime(2024, 12, 31), max_posts=10, per=("author",),
    )
    return chosen.select(
        "article_id", "author", "url", "title", F.array_join("tags", "|").alias("tags"), "claps",
        "responses", "is_premium", dates.iso_format("published_at").alias("published_at"),
    )


def newest_long_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Newest ten articles per author with more than 200 words, and their reading minutes."""
    articles = A.articles(T.scan_table(spark, folder, "documents"), word_count=X.word_count("text"))
    rows = articles.filter("word_count > 200")
    top = R.limit_posts(rows, 10, per=("author",), rank="rank")
    return top.select(
        "author", F.col("rank").cast("bigint").alias("rank"), "article_id", "title", "word_count",
        X.minutes_for_words("word_count").alias("read_minutes"),
    )


def page_run_stats(pages: DataFrame) -> DataFrame:
    """Stored pages, classified by barrier, as run statistics per host.

    ``html`` is read once and dropped inside the scan stage; only a few flags per
    page are partially aggregated and shuffled.  A page that is read but gives no title or
    no text is an error.
    """
    def nothing_read(markup: Column) -> Column:
        text = F.array_join(M.content_containers(markup), "")
        return (H.first_text(markup, V.TITLE) == "") | (H.element_text(text) == "")

    classified = barrier.barrier_classify(pages, nothing_read=nothing_read)
    outcomes = classified.select(
        X.domain("url").alias("host"), "has_barrier", (~F.col("has_barrier") & F.col("nothing_read")).alias("is_error"),
        F.timestamp_seconds(F.lit(A.EPOCH) + F.col("page_id")).alias("scraped_at"),
    )
    return stats.run_stats(outcomes, ("host",))
