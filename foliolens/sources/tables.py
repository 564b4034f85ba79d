"""Table, request and event sources.  Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import schemas
from foliolens.functions import text as X


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_pages(spark: SparkSession, folder: str, host: str | None = None) -> DataFrame:
    """Stored pages, of one host if asked for: the URL's host decides, whatever its case, port or path."""
    pages = spark.read.schema(schemas.PAGES).parquet(f"{folder}/pages.parquet")
    if host is None:
        return pages
    return pages.filter(X.domain(F.col("url")) == host.lower().removeprefix("www."))


def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{folder}/events.parquet")


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream; ``ts`` becomes TIMESTAMP, as watermarks need it."""
    reader = spark.readStream.schema(schemas.EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Job requests from line-delimited JSON."""
    return spark.read.schema(schemas.REQUESTS).json(path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored result records: ``(type, data VARIANT, scraped_at)``."""
    return spark.read.schema(schemas.RESULTS).parquet(path)


def article_results(results: DataFrame) -> DataFrame:
    return results.filter("type = 'article'").select("data", "scraped_at")


def first_author(results: DataFrame) -> DataFrame:
    """The author record that was stored first (by time of storing, then by content)."""
    authors = results.filter("type = 'author'").select(
        F.to_json("data").alias("data"), "scraped_at"
    )
    return authors.orderBy("scraped_at", "data").limit(1).select(F.parse_json("data").alias("data"), "scraped_at")
