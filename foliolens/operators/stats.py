"""Run, barrier, export and source statistics.

All are plain grouped aggregates: partial sums are taken in the map tasks, so a
group with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as X
from foliolens.operators.exports import export_format


def run_stats(outcomes: DataFrame, group_keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals and rates of a run.

    ``outcomes`` has one row per article page: ``has_barrier``, ``is_error`` and
    ``scraped_at``.  Pages skipped for a barrier are part of the total.
    """
    hit, failed = F.col("has_barrier"), F.col("is_error")
    grouped = outcomes.groupBy(*group_keys).agg(
        F.count("*").alias("total_articles"),
        F.count_if(~hit & ~failed).alias("successful_extractions"),
        F.count_if(hit).alias("paywall_hits"),
        F.count_if(failed).alias("errors"),
        (F.unix_millis(F.max("scraped_at")) - F.unix_millis(F.min("scraped_at"))).alias("session_duration"),
    )
    return grouped.withColumns(
        {
            "session_duration": F.coalesce("session_duration", F.lit(0).cast("bigint")),
            "paywall_rate": X.percent("paywall_hits", "total_articles"),
            "success_rate": X.percent("successful_extractions", "total_articles"),
        }
    )


def barrier_stats(classified: DataFrame, group_keys: tuple[str, ...] = ()) -> DataFrame:
    indicators = F.col("indicators")
    grouped = classified.groupBy(*group_keys).agg(
        F.count("*").alias("total_articles"),
        F.count_if(F.array_contains(indicators, "premium")).alias("premium_articles"),
        F.count_if(F.array_contains(indicators, "member_only")).alias("member_only_articles"),
        F.count_if("has_barrier").alias("paywall_hits"),
    )
    return grouped.withColumn("paywall_rate", X.percent("paywall_hits", "total_articles"))


def export_stats(
    articles: DataFrame, group_keys: tuple[str, ...] = (), wanted_format: str | None = None, scraped_at: str | None = None
) -> DataFrame:
    """Needs ``author, word_count, comments_count, is_premium, claps, responses, read_time``.

    With a format the statistics also say which it is, whose articles they are (the first name, or
    ``Unknown``), and when they were scraped.
    """
    zero = F.lit(0)

    def total(name: str):
        return F.sum(F.coalesce(F.col(name), zero))

    grouped = articles.groupBy(*group_keys).agg(
        F.count("*").alias("total_articles"),
        F.coalesce(F.bool_or(F.length("author") > 0), F.lit(False)).alias("has_author_data"),
        F.coalesce(F.bool_or(F.col("word_count").isNotNull()), F.lit(False)).alias("has_content_data"),
        F.coalesce(F.bool_or(F.col("comments_count") > 0), F.lit(False)).alias("has_comments_data"),
        F.count_if(F.coalesce("is_premium", F.lit(False))).alias("premium_articles"),
        F.coalesce(total("claps"), zero).alias("total_claps"),
        F.coalesce(total("responses"), zero).alias("total_responses"),
        total("read_time").alias("_minutes"),
        F.coalesce(F.min(F.when(F.length("author") > 0, F.col("author"))), F.lit("Unknown")).alias("author_name"),
    )
    average = F.floor(F.col("_minutes") / F.col("total_articles") + 0.5).cast("bigint")
    told = grouped.withColumn(
        "average_read_time", F.when(F.col("total_articles") > 0, average).otherwise(F.lit(0).cast("bigint"))
    ).drop("_minutes")
    if wanted_format is None:
        return told.drop("author_name")
    return told.withColumns({"format": export_format(F.lit(wanted_format)), "scraped_at": F.lit(scraped_at)})


def comment_totals(comments: DataFrame, group_keys: tuple[str, ...] = ()) -> DataFrame:
    return comments.groupBy(*group_keys).agg(F.count("*").alias("total_comments_scraped"))


def source_success(attempts: DataFrame, source: str = "source") -> DataFrame:
    """Successes and failures per source; ``attempts.success`` is a boolean.

    Attempts whose outcome is null are counted by themselves and are no part of total and rate.
    """
    grouped = attempts.groupBy(source).agg(
        F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        F.count_if(F.col("success").isNull()).alias("unknown_requests"),
    )
    total = F.col("successful_requests") + F.col("failed_requests")
    return grouped.withColumn("total_requests", total).withColumn(
        "success_rate", X.percent("successful_requests", "total_requests")
    )
