"""Structured Streaming forms of the event and listing operators.

Counters, rates and sessions are sums, so a micro-batch is summed by itself and its sums
are stored under its number; reading adds the sums of all batches.  Keys that were seen are stored
the same way.  No row is ever too late, no window stays open, and no state is kept between
batches.  A batch that is run again replaces its own rows, and older ones are merged by levels
(``streaming.store``).  Streams carry ``ts`` as TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.operators import events as E
from foliolens.streaming.store import BatchStore

# Buckets of stored keys; a batch reads only those its own keys fall into.
KEY_BUCKETS = 64


def _run(stream: DataFrame, folder: str, store: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch of what is there to ``store``; started again with ``folder``, the job goes on."""
    writer = stream.writeStream.foreachBatch(store).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/progress").start().awaitTermination()


def stream_dedupe(items: DataFrame, folder: str, keys: tuple[str, ...] = ("url",), time: str = "ts") -> DataFrame:
    """The first row of every key, however late others come; batch twin: ``keep_first_by_url``.

    The first row is that of the earliest micro-batch, in it that of the smallest ``time``, then of the
    smallest other columns.  Null keys are keys like others.
    """
    key = F.struct(*[F.col(name).alias(name) for name in keys])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    schema = items.withColumn("_bucket", F.lit(0)).schema
    # The keys of two parts never meet: each part holds only keys that no earlier one has.
    store = BatchStore(items.sparkSession, f"{folder}/keys", schema, lambda rows: rows, ("_bucket",))

    def add(batch: DataFrame, number: int) -> None:
        order = F.struct(time, *[name for name in batch.columns if name != time])
        firsts = batch.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*batch.columns), order).alias("_row")).select("_key", "_row.*")
        fresh = firsts.withColumn("_bucket", bucket)
        earlier = [part for part in store.parts() if part[0] < number]
        buckets = [row[0] for row in fresh.select("_bucket").distinct().collect()]
        seen = store.read(earlier).filter(F.col("_bucket").isin(buckets)).select(key.alias("_seen"))
        store.add(fresh.join(seen, F.col("_key").eqNullSafe(F.col("_seen")), "left_anti"), number)

    _run(items, folder, add)
    return store.read().drop("_bucket")


def stored_sums(
    stream: DataFrame, folder: str, sums: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Sums of every micro-batch of what is there, under ``folder``, as sums of all."""
    store = BatchStore(stream.sparkSession, f"{folder}/sums", sums(stream).schema, merged)
    _run(stream, folder, lambda batch, number: store.add(sums(batch), number))
    return merged(store.read())


def stream_session_stats(
    events: DataFrame, folder: str, key: str = "user_id", gap_minutes: int = V.SESSION_GAP_MINUTES
) -> DataFrame:
    """Sessions with counters; batch twin: ``session_stats``."""
    minutes = stored_sums(
        events, folder, lambda batch: E.minute_sums(batch, key), lambda parts: E.merged_minutes(parts, key)
    )
    return E.sessions_of_minutes(minutes, key, gap_minutes)


def stream_counters(events: DataFrame, folder: str, width: str = "1 hour") -> DataFrame:
    """Events per type and window; batch twin: ``counts_by_window``."""
    def merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start", "window_end", "event_type").agg(F.sum("n").alias("n"))

    return stored_sums(events, folder, lambda batch: E.counts_by_window(batch, width), merged)


def stream_rate_audit(events: DataFrame, folder: str, requests_per_second: float, key: str = "user_id") -> DataFrame:
    """Events per key and minute against the limit; batch twin: ``rate_audit``."""
    def merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy(key, "minute").agg(F.sum("requests").alias("requests"))

    counted = stored_sums(events, folder, lambda batch: E.requests_per_minute(batch, key), merged)
    return E.over_limit(counted, requests_per_second)


def run_available(stream: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Append everything that is there to a table under ``folder`` and read it.

    Output and progress stand together there, so a job started again with the same folder
    goes on without loss or repeats.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.option("checkpointLocation", f"{folder}/progress").start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
