"""A run over stored pages: barrier, article and outcome of every page from one scan.

Each page is read once.  Its envelope goes to the folder of its outcome, and the totals of
the run are observed while the envelopes are written, so they cost no second pass.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliolens.functions import text as X
from foliolens.operators import barrier, exports, state

ARTICLE, SKIPPED, ERROR = "article", "skipped", "error"


def run_envelopes(
    pages: DataFrame,
    now: Column,
    scraped_at: Column,
    premium_content: bool = False,
    include_comments: bool = True,
    include_publication: bool = True,
) -> DataFrame:
    """One row per page: ``page_id, url, host, outcome, barrier, scraped_at`` and its article's parts.

    ``outcome`` is ``skipped`` for a page behind a barrier unless premium content is wanted,
    ``error`` for a page that gives no title or no text, else ``article``.  Parts of skipped pages
    and errors are null; a skipped page's markup is let go before anything is extracted from it.
    ``scraped_at`` may use the columns of ``pages``.
    """
    timed = pages.select("page_id", "url", "html", scraped_at.alias("scraped_at"))
    classified = barrier.barrier_classify(timed, "html", "scraped_at", _markup=lambda markup: markup)
    told = classified.select(
        "page_id", "url", F.col("url").alias("_url"), "html", "_markup", "scraped_at", X.domain("url").alias("host"),
        F.struct("has_barrier", "barrier_type", "indicators", "confidence").alias("barrier"),
    )
    skipped = F.lit(False) if premium_content else F.col("barrier.has_barrier")
    marked = X.computed(told, _skipped=skipped)
    read = marked.withColumns(
        {name: F.when(~F.col("_skipped"), F.col(name)) for name in ("html", "_markup")}
    )
    found = state.assemble_article(
        read, now, include_comments=include_comments, include_publication=include_publication,
        keep=("_url", "host", "barrier", "scraped_at", "_skipped"), cleaned=F.col("_markup"),
    )
    nothing = (X.text_or_empty("article.title") == "") | (X.text_or_empty("content.text_content") == "")
    outcome = F.when(F.col("_skipped"), F.lit(SKIPPED)).when(nothing, F.lit(ERROR)).otherwise(F.lit(ARTICLE))
    routed = X.computed(found, outcome=outcome)
    parts = [name for name in ("article", "content", "comments", "publication") if name in found.columns]
    return routed.select(
        "page_id", F.col("_url").alias("url"), "host", "outcome", "barrier", "scraped_at",
        *[F.when(F.col("outcome") == ARTICLE, F.col(name)).alias(name) for name in parts],
    )


def _counters() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count("*").alias("total_articles"),
        F.count_if(outcome == ARTICLE).alias("successful_extractions"),
        F.count_if("barrier.has_barrier").alias("paywall_hits"),
        F.count_if(outcome == ERROR).alias("errors"),
        F.coalesce(
            F.unix_millis(F.max("scraped_at")) - F.unix_millis(F.min("scraped_at")), F.lit(0).cast("bigint")
        ).alias("session_duration"),
    ]


def percent_text(part: int, total: int) -> str:
    """100 * part / total with two decimals, half away from zero; 0.00 without a total."""
    rate = Decimal(100 * part) / Decimal(total) if total else Decimal(0)
    return str(rate.quantize(Decimal("0.01"), ROUND_HALF_UP))


def page_run(envelopes: DataFrame, path: str) -> dict:
    """Writes the envelopes, each to the folder of its outcome, and returns the totals of the run.

    The totals come from the write itself.  No shuffle stands before it, so that a task that is
    run again on another executor counts once.
    """
    totals = Observation("page_run")
    counters = _counters()
    if "comments" in envelopes.columns:
        counters.append(F.coalesce(F.sum(F.size("comments")), F.lit(0)).cast("bigint").alias("total_comments"))
    envelopes.observe(totals, *counters).write.mode("overwrite").partitionBy("outcome").parquet(path)
    counted = dict(totals.get)
    return {
        **counted,
        "paywall_rate": percent_text(counted["paywall_hits"], counted["total_articles"]),
        "success_rate": percent_text(counted["successful_extractions"], counted["total_articles"]),
    }


def read_run(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored envelopes, with the columns of ``like`` also where no page had an outcome."""
    return spark.read.schema(like.schema).parquet(path)


def host_stats(stored: DataFrame) -> DataFrame:
    """Statistics of a run per host; of the stored envelopes only a few flags are read."""
    grouped = stored.groupBy("host").agg(*_counters())
    return grouped.withColumns(
        {
            "paywall_rate": X.percent("paywall_hits", "total_articles"),
            "success_rate": X.percent("successful_extractions", "total_articles"),
        }
    )


def run_articles(stored: DataFrame) -> DataFrame:
    """The articles of a run with all that the 24-column export shows, row by row."""
    found = stored.filter(F.col("outcome") == ARTICLE)
    text = F.col("content.text_content")
    n_comments = F.size("comments").cast("bigint") if "comments" in stored.columns else F.lit(0).cast("bigint")
    named = found.select(
        "page_id", "host", "scraped_at", "article.*", F.col("barrier.barrier_type").alias("barrier_type"),
        F.col("content.word_count").alias("word_count"), n_comments.alias("comments_count"), text.alias("_text"),
    )
    return named.withColumns(
        {
            "keywords": X.keywords("_text"), "hashtags": X.hashtags("_text"),
            "mentions": X.mentions("_text"), "preview": exports.preview("_text"),
        }
    ).drop("_text")


def public_articles(stored: DataFrame) -> DataFrame:
    """The articles of a run under their public names, each with its comments, row by row.

    Only a page's own comments are nested, so a row never holds more than its page did.
    """
    found = stored.filter(F.col("outcome") == ARTICLE)
    minutes = F.col("article.read_time")
    whole = F.when(minutes == F.floor(minutes), F.floor(minutes).cast("string")).otherwise(minutes.cast("string"))
    comments = F.transform(
        "comments",
        lambda c: F.struct(c["author"].alias("user"), c["content"].alias("comment"), c["claps"].alias("likes")),
    )
    return found.select(
        "page_id", "article.title", "article.author", F.coalesce("article.publication.name", F.lit("")).alias("publication"),
        "article.url", F.col("content.text_content").alias("content"), F.col("content.word_count").alias("word_count"),
        F.concat(whole, F.lit(" min")).alias("read_time"), "article.is_premium", "article.tags",
        comments.alias("comments"), "scraped_at",
    )


def public_totals(totals: dict) -> dict:
    """The public statistics of a run from the totals that ``page_run`` returned."""
    return {
        "total_articles_scraped": totals["successful_extractions"],
        "total_comments_scraped": totals.get("total_comments", 0),
        "time_taken": f"{totals['session_duration'] / 1000:.1f} seconds",
    }


def summary_of(totals: dict, author_name: str | None, author_url: str | None, scraped_at: str) -> dict[str, str]:
    """Cells of the closing ``STATISTICS`` row from the totals of a run; cells left out are empty."""
    return {
        "Article Title": "STATISTICS",
        "Author Name": author_name or "Unknown",
        "Author URL": author_url or "",
        "Word Count": str(totals["total_articles"]),
        "Content Summary": (
            f"Total Articles: {totals['total_articles']}, Success Rate: {totals['success_rate']}%, "
            f"Paywall Rate: {totals['paywall_rate']}%"
        ),
        "Comments Count": str(totals["errors"]),
        "Paywall Type": f"Session Duration: {totals['session_duration']}ms",
        "Scraped At": scraped_at,
    }
