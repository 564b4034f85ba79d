"""Log-event analytics in batch: counters, sessions and rates.

The streaming forms in :mod:`foliolens.streaming` share these expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as X

# Which event type feeds which counter.
EVENT_COUNTERS = {
    "view": "articles_scraped",
    "error": "errors",
    "signup": "warnings",
    "click": "retries",
    "purchase": "paywall_hits",
    "switch": "proxy_changes",
}


def counters(event_type: str = "event_type") -> list[Column]:
    return [F.count_if(F.col(event_type) == kind).alias(name) for kind, name in EVENT_COUNTERS.items()]


def with_success_rate(counted: DataFrame) -> DataFrame:
    """100 * (articles - errors) / articles; negative when errors outnumber articles."""
    return counted.withColumn(
        "success_rate", X.percent(F.col("articles_scraped") - F.col("errors"), "articles_scraped")
    )


def event_counters(events: DataFrame, group_keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    duration = (_millis(F.max("ts")) - _millis(F.min("ts"))).alias("session_duration")
    return with_success_rate(events.groupBy(*group_keys).agg(duration, *counters()))


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def metric_value(counted: DataFrame) -> DataFrame:
    """The eight counters of every row as ``(…, metric, value)`` rows."""
    names = (
        "session_duration", "articles_scraped", "errors", "warnings", "retries", "paywall_hits",
        "proxy_changes", "success_rate",
    )
    keys = [name for name in counted.columns if name not in names]
    renamed = counted.select(
        *keys, *[F.col(name).cast("double").alias(title) for name, title in zip(names, V.METRIC_NAMES)]
    )
    return renamed.unpivot(keys, list(V.METRIC_NAMES), "metric", "value")


def minute_sums(events: DataFrame, key: str = "user_id") -> DataFrame:
    """First and last time and counters per key and minute.

    A key with a third of all events shrinks to one row per minute in the map tasks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("_micros", micros).groupBy(key, F.expr("_micros div 60000000").alias("_minute")).agg(
        F.min("_micros").alias("_first"), F.max("_micros").alias("_last"), F.count("*").alias("events"), *counters(),
    )


def merged_minutes(parts: DataFrame, key: str = "user_id") -> DataFrame:
    """Minute sums of several batches as those of all of them."""
    names = ["events", *EVENT_COUNTERS.values()]
    return parts.groupBy(key, "_minute").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(name).alias(name) for name in names]
    )


def sessions_of_minutes(
    minutes: DataFrame, key: str = "user_id", gap_minutes: int = V.SESSION_GAP_MINUTES
) -> DataFrame:
    """Sessions from minute sums.

    A minute is shorter than the gap, so its events always share a session.  A key is cut
    into days: rows are put in order inside a day, only each day's ends and number of
    session starts are put in order for the key.
    """
    if gap_minutes < 1:
        raise ValueError("gap_minutes must be at least 1")
    gap_micros = gap_minutes * 60 * 1_000_000
    names = list(EVENT_COUNTERS.values())
    by_time = Window.partitionBy(key, "_day").orderBy("_minute")
    daily = minutes.withColumn("_day", F.expr("_minute div 1440"))
    gap = F.col("_first") - F.lag("_last").over(by_time) >= gap_micros
    # The first minute of a day is judged by the day before.
    marked = daily.withColumn("_starts", F.coalesce(gap, F.lit(False)).cast("int"))
    days = marked.groupBy(key, "_day").agg(
        F.min("_first").alias("_opens"), F.max("_last").alias("_closes"), F.sum("_starts").alias("_inside")
    )
    in_order = Window.partitionBy("_key").orderBy("_of")
    fresh = F.coalesce(F.col("_opens") - F.lag("_closes").over(in_order) >= gap_micros, F.lit(True)).cast("int")
    placed = days.select(F.col(key).alias("_key"), F.col("_day").alias("_of"), "_opens", "_closes", "_inside").withColumn(
        "_fresh", fresh
    ).select(
        "_key", "_of",
        (F.sum(F.col("_fresh") + F.col("_inside")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside")).alias("_base"),
    )
    numbered = marked.join(placed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_of"))).withColumn(
        "_session", F.col("_base") + F.sum("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    sessions = numbered.groupBy(key, "_session").agg(
        F.timestamp_micros(F.min("_first")).alias("session_start"),
        F.timestamp_micros(F.max("_last") + gap_micros).alias("session_end"),
        F.expr("max(_last) div 1000 - min(_first) div 1000").alias("session_duration"),
        F.sum("events").alias("events"),
        *[F.sum(name).alias(name) for name in names],
    )
    return with_success_rate(sessions.drop("_session"))


def session_stats(
    events: DataFrame, key: str = "user_id", gap_minutes: int = V.SESSION_GAP_MINUTES
) -> DataFrame:
    """Sessions per key (a gap of ``gap_minutes`` or more starts a new one) with counters."""
    return sessions_of_minutes(minute_sums(events, key), key, gap_minutes)


def requests_per_minute(events: DataFrame, key: str = "user_id") -> DataFrame:
    counted = events.groupBy(key, F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("minute"), "requests")


def over_limit(counted: DataFrame, requests_per_second: float) -> DataFrame:
    return counted.withColumn("over_limit", F.col("requests") > F.lit(requests_per_second * 60))


def rate_audit(
    events: DataFrame, requests_per_second: float, key: str = "user_id"
) -> DataFrame:
    """Events per key and minute against the limit of ``requests_per_second * 60``."""
    return over_limit(requests_per_minute(events, key), requests_per_second)


def counts_by_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window; the batch twin of the running counters."""
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n"
    )
