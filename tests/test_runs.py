"""Runs over pages: outcomes, totals of the same pass, and framed documents."""

import re

import pytest
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.operators import exports, runs
from foliolens.plans.queries import QUERIES
from foliolens.session import new_folder
from foliolens.sources import adapters as A, tables as T

LONG = "<p>" + "word " * 200 + "</p>"
PAGES = [
    (1, "https://a.example.com/p/1", f"<h1>One</h1><article>{LONG}</article>"),
    (2, "https://a.example.com/p/2", f"<span data-testid='memberOnlyBadge'>x</span><h1>Two</h1><article>{LONG}</article>"),
    (3, "https://b.example.com/p/3", f"<article>{LONG}</article>"),
    (4, "https://b.example.com/p/4", "<h1>Short</h1><article><p>a</p></article>"),
    (5, None, None),
]


def now():
    return F.lit("2024-03-31").cast("timestamp")


def envelopes(spark, pages=PAGES, **options):
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    return runs.run_envelopes(rows, now(), F.timestamp_seconds(F.col("page_id")), **options)


def test_outcomes_and_parts(spark):
    rows = {row["page_id"]: row for row in envelopes(spark).collect()}
    assert [rows[i]["outcome"] for i in range(1, 6)] == ["article", "skipped", "error", "skipped", "skipped"]
    assert [rows[i]["barrier"]["barrier_type"] for i in range(1, 6)] == [None, "premium", None, "content_truncation", "content_truncation"]
    assert rows[1]["article"]["title"] == "One" and rows[1]["content"]["word_count"] == 200
    assert rows[1]["url"] == PAGES[0][1] and rows[2]["url"] == PAGES[1][1]
    assert all(rows[i]["article"] is None and rows[i]["content"] is None for i in (2, 3, 4, 5))


def test_premium_content_is_read_and_keeps_its_barrier(spark):
    rows = {row["page_id"]: row for row in envelopes(spark, premium_content=True).collect()}
    assert [rows[i]["outcome"] for i in range(1, 6)] == ["article", "article", "error", "article", "error"]
    assert rows[2]["barrier"]["barrier_type"] == "premium"


def test_totals_of_the_write_are_those_of_the_hosts(spark, sf_dir):
    pages = A.run_pages(T.scan_table(spark, sf_dir, "documents"))
    found = runs.run_envelopes(pages, now(), F.timestamp_seconds(F.col("page_id")))
    path = new_folder(spark, "run")
    totals = runs.page_run(found, path)
    stored = runs.read_run(spark, path, found)
    hosts = runs.host_stats(stored).collect()
    for name in ("total_articles", "successful_extractions", "paywall_hits", "errors"):
        assert totals[name] == sum(row[name] for row in hosts)
    assert totals["total_articles"] == pages.count()


def test_one_scan_and_no_html_in_an_exchange(spark, sf_dir):
    found = envelopes(spark)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pages = T.scan_pages(spark, sf_dir)
    plan = runs.run_envelopes(pages, now(), F.col("page_id").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_a_run_without_pages(spark):
    found = envelopes(spark, [])
    path = new_folder(spark, "run")
    totals = runs.page_run(found, path)
    assert (totals["total_articles"], totals["session_duration"], totals["success_rate"]) == (0, 0, "0.00")
    stored = runs.read_run(spark, path, found)
    assert stored.count() == 0 and runs.host_stats(stored).count() == 0
    report = path + "-csv"
    exports.sink_csv_report(
        exports.export_rows(runs.run_articles(stored), "now"), report, lambda _: runs.summary_of(totals, None, None, "now")
    )
    assert [tuple(row) for row in exports.read_framed(spark, report).collect()] == [(0, V.NO_ARTICLES)]


def test_rates_are_rounded_half_away_from_zero():
    assert [runs.percent_text(*pair) for pair in ((1, 3), (2, 3), (1, 800), (0, 0))] == ["33.33", "66.67", "0.13", "0.00"]


def document(spark, path):
    parts = exports.read_framed(spark, path).collect()
    return ["".join(row["line"] for row in parts if row["part"] == part) for part in (0, 1, 2)]


def test_html_report_without_rows_and_with_an_odd_name(spark):
    article = spark.sql(
        "select 1 as article_id, 'a<b' as title, 'n' as author, 'u' as url, array('x','y') as tags, 1L as claps, 2L as responses, true as is_premium, timestamp'2024-01-01' as published_at"
    )
    rates = lambda counted: {"total_articles": counted["n_lines"], "success_rate": "0.00", "paywall_rate": "100.00"}
    path = new_folder(spark, "report")
    exports.sink_html_report(article, path, "<A&B>", "now", rates)
    head, rows, foot = document(spark, path)
    assert "Articles - &lt;A&amp;B&gt;" in head and "<p><strong>Total Articles:</strong> 1</p>" in head
    assert rows.startswith("<tr><td>a&lt;b</td>") and foot == "</tbody></table></body></html>"
    exports.sink_html_report(article.limit(0), path, None, "now", rates)
    assert document(spark, path) == [f"<html><body><p>{V.NO_ARTICLES}</p></body></html>", "", ""]


def test_a_document_that_was_not_finished_is_refused(spark):
    path = new_folder(spark, "report")
    lines = spark.range(3).select(F.col("id").cast("string").alias("line"))

    def broken(_):
        raise RuntimeError("lost")

    exports.sink_framed(lines, path, lambda _: ["head"], lambda _: ["foot"], "none")
    with pytest.raises(RuntimeError):
        exports.sink_framed(lines, path, lambda _: ["head"], broken, "none")
    with pytest.raises(ValueError):
        exports.read_framed(spark, path)
    totals = exports.sink_framed(lines, path, lambda t: [f"head {t['last']}"], lambda _: ["foot"], "none", last=F.max("line"))
    assert totals == {"n_lines": 3, "last": "2"}
    assert sorted(map(tuple, exports.read_framed(spark, path).collect())) == [(0, "head 2"), (1, "0"), (1, "1"), (1, "2"), (2, "foot")]


def test_public_totals():
    totals = {"successful_extractions": 3, "total_comments": 7, "session_duration": 45_200}
    assert runs.public_totals(totals) == {"total_articles_scraped": 3, "total_comments_scraped": 7, "time_taken": "45.2 seconds"}


def test_a_run_reads_a_page_by_few_python_functions(spark):
    """Barrier, page and containers: each function has a Python worker of its own in every task, with a batch of pages."""
    plan = envelopes(spark)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) <= 3


@pytest.mark.parametrize("text, kind", [("Member-<b>only</b> story", "premium"), ("Sign <i>in</i>", "login_required"), ("x", None)])
def test_text_cues_are_read_through_tags(spark, text, kind):
    """Text boxes and body come from one look at the page; boxes are looked for only where the page holds a cue."""
    pages = [(1, "https://a.example.com/p/1", f"<span>{text}</span><a>{text}</a><article>{LONG}</article>"), (2, None, None)]
    rows = {row["page_id"]: row["barrier"]["barrier_type"] for row in envelopes(spark, pages).collect()}
    assert rows == {1: kind, 2: "content_truncation"}


def test_a_run_as_csv_bounds_its_batches_and_keeps_all_rows(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256m")
        report = QUERIES["page_run_csv"](spark, sf_dir)
        assert int(spark.conf.get(name).rstrip("b")) <= 8 * 1024 * 1024
        # A head, a row for each document, and the line of totals.
        assert report.count() == T.scan_table(spark, sf_dir, "documents").count() + 2
    finally:
        spark.conf.set(name, before)
