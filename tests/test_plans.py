"""Plans: what reaches the scan, what is shuffled, and what is streamed."""

import re

from pyspark.sql import functions as F

from foliolens.operators import events as E, relational as R
from foliolens.plans import flagship
from foliolens.sources import adapters as A, tables as T
from foliolens.streaming import jobs


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def exchanges(plan: str) -> list[str]:
    return re.findall(r"\(\d+\) Exchange\n(?:.*\n)*?\n", plan)


def test_host_filter_decides_on_the_whole_host(spark, tmp_path):
    urls = [
        "https://example.com", "https://example.com?x=1", "HTTPS://Example.com/a", "https://example.com:443/", "http://www.example.com/b",
        "https://example.com.org/", "https://other.org/example.com", "nothing",
    ]
    rows = [(i, url, "") for i, url in enumerate(urls)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    kept = T.scan_pages(spark, str(tmp_path), "example.com").select("page_id").collect()
    assert sorted(row["page_id"] for row in kept) == [0, 1, 2, 3, 4]


def test_html_is_not_shuffled(spark, sf_dir):
    plan = plan_of(flagship.page_run_stats(T.scan_pages(spark, sf_dir)))
    found = exchanges(plan)
    assert found and not any("html" in e or "markup" in e for e in found)


def test_text_is_not_shuffled_and_tops_are_limited_before_the_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(flagship.newest_long_articles(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any(re.search(r"\btext#", e) for e in exchanges(plan))
    assert plan.count("WindowGroupLimit") >= 2
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def test_no_cross_joins_or_python_in_the_flagship(spark, sf_dir):
    plan = plan_of(flagship.filter_sort_limit(spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoop|Python|Pandas", plan)


def test_keywords_do_not_shuffle(spark, sf_dir):
    from foliolens.operators import keywords as K

    plan = plan_of(K.keywords_topk(T.scan_table(spark, sf_dir, "documents")))
    assert not exchanges(plan)


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_streams_equal_batches_after_a_restart_and_late_rows(spark, sf_dir, tmp_path):
    """The second half of the events, which comes first in time, is read by a second start in the same folders."""
    events = T.scan_events(spark, sf_dir)
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (events.filter(F.col("event_id") > middle), events.filter(F.col("event_id") <= middle)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        stream = lambda: T.stream_events(spark, str(tmp_path))
        sessions = jobs.stream_session_stats(stream(), f"{tmp_path}/sessions")
        counts = jobs.stream_counters(stream(), f"{tmp_path}/counts")
        rates = jobs.stream_rate_audit(stream(), f"{tmp_path}/rates", 1 / 60)
    assert rows_of(sessions) == rows_of(E.session_stats(events))
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows_of(counts) == rows_of(E.counts_by_window(typed))
    assert rows_of(rates) == rows_of(E.rate_audit(typed, 1 / 60))


def test_sessions_equal_session_windows(spark, sf_dir):
    events = T.scan_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ours = E.session_stats(events).select("user_id", "session_start", "session_end", "events")
    native = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    native = native.select("user_id", "w.start", "w.end", "events")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, native.collect()))


def test_a_hot_key_is_kept_whole(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("user_id"),
        F.timestamp_seconds(F.lit(A.EPOCH) + F.col("id")).alias("ts"), F.lit("view").alias("event_type"),
    )
    sessions = E.session_stats(rows)
    assert sessions.agg(F.sum("events")).first()[0] == 20_000
    assert sessions.filter("user_id = 0").count() == 1


def test_summary_rows_sum_to_detail(spark, sf_dir):
    listing = A.listing(T.scan_table(spark, sf_dir, "documents"))
    counts = R.cumulative_batches(listing, 10)
    assert counts.agg(F.sum("new_items")).first()[0] == R.keep_first_by_url(listing).count()


def test_items_are_deduplicated_once(spark, sf_dir):
    plan = plan_of(R.cumulative_until_limit(A.listing(T.scan_table(spark, sf_dir, "documents")), 3))
    assert not any("hashpartitioning(url" in e for e in exchanges(plan))


def test_a_deep_page_takes_no_rows_before_it(spark, sf_dir):
    articles = A.articles(T.scan_table(spark, sf_dir, "documents"))
    plan = plan_of(R.paginate_by_place(articles, 150, 20))
    single = [e for e in exchanges(plan) if "SinglePartition" in e]
    assert single and not any("url" in e or "title" in e for e in single)
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_articles_of_authors_are_scanned_once_for_counts_and_once_for_rows(spark, sf_dir):
    articles = A.articles(T.scan_table(spark, sf_dir, "documents"))
    plan = plan_of(R.author_articles(articles, ("article_id",), 20))
    assert len(re.findall(r"\(\d+\) Scan parquet", plan)) == 2
