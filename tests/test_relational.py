from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliolens.operators import relational as R
from foliolens.operators import requests as Q
from foliolens.operators import stats


@pytest.fixture(scope="module")
def articles(spark):
    day = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [
            (1, "a", "u1", ["Data Science"], 5, 1, False, day.replace(day=3)),
            (2, "a", "u2", [], 9, 0, False, None),
            (3, "a", "u3", ["ai"], 1, 1, True, day.replace(day=5)),
            (4, "b", "u4", None, 6, 0, None, day.replace(day=1)),
            (5, "b", "u5", ["x"], None, 6, False, day.replace(day=3)),
        ],
        "article_id bigint, author string, url string, tags array<string>, claps bigint, responses bigint, "
        "is_premium boolean, published_at timestamp",
    )


def ids(frame):
    return [row["article_id"] for row in frame.select("article_id").collect()]


def test_filters(articles):
    assert sorted(ids(R.filter_tags(articles, ["data", "AI safety"]))) == [1, 3]
    assert sorted(ids(R.filter_tags(articles, []))) == [1, 2, 3, 4, 5]
    assert sorted(ids(R.filter_dates(articles, datetime(2024, 1, 3), datetime(2024, 1, 4)))) == [1, 2, 5]
    assert sorted(ids(R.filter_premium(articles))) == [1, 2, 4, 5]
    assert sorted(ids(R.filter_premium(articles, True))) == [1, 2, 3, 4, 5]


def test_filters_commute(articles):
    one = R.filter_premium(R.filter_dates(articles, datetime(2024, 1, 3)))
    other = R.filter_dates(R.filter_premium(articles), datetime(2024, 1, 3))
    assert sorted(ids(one)) == sorted(ids(other))


def test_orders(articles):
    assert ids(R.sorted_articles(articles, "latest")) == [3, 1, 5, 4, 2]
    assert ids(R.sorted_articles(articles, "oldest")) == [4, 1, 5, 3, 2]
    assert ids(R.sorted_articles(articles, "popular")) == [2, 1, 4, 5, 3]
    with pytest.raises(ValueError):
        R.sorted_articles(articles, "random")


def test_limits(articles):
    assert ids(R.limit_posts(articles, 2, "popular")) == [2, 1]
    assert sorted(ids(R.limit_posts(articles, 1, per=("author",)))) == [3, 5]
    assert ids(R.paginate(articles, 1, 2, R.sort_order("latest"))) == [1, 5]
    for sort_by in ("latest", "oldest", "popular"):
        for offset, limit in ((0, 1), (1, 2), (2, 10), (0, 0), (99, 5)):
            plain = ids(R.paginate(articles, offset, limit, R.sort_order(sort_by)))
            assert ids(R.paginate_by_place(articles, offset, limit, sort_by)) == plain
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            R.limit_posts(articles, wrong)


def test_bundle(articles):
    rows = {(r["author"], r["part"]): r for r in R.author_articles(articles, ("article_id",), 2).collect()}
    assert [a["article_id"] for a in rows["a", 0]["articles"]] == [3, 1]
    assert len(rows["a", 1]["articles"]) == 1 and rows["a", 0]["total_articles"] == rows["a", 1]["total_articles"] == 3


@pytest.mark.parametrize("sort_by", ["latest", "oldest", "popular"])
def test_numbers_follow_the_order(articles, sort_by):
    ranked = R.numbered_posts(articles, "author", sort_by).collect()
    for author in {row["author"] for row in ranked}:
        wanted = ids(R.sorted_articles(articles.filter(F.col("author") == author), sort_by))
        own = sorted((row["_rank"], row["article_id"]) for row in ranked if row["author"] == author)
        assert own == list(enumerate(wanted, 1))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("u1", 0, 0, "a"), ("u2", 0, 1, "a"), ("u1", 1, 0, "a"), ("u3", 1, 1, "a"), ("u3", 1, 2, "a"), ("u4", 2, 0, "a"), ("u9", 0, 0, "b")],
        "url string, batch bigint, index bigint, author string",
    )


def test_dedupe_is_stable(items):
    once = R.keep_first_by_url(items)
    assert sorted((r["url"], r["batch"], r["index"]) for r in once.collect()) == [
        ("u1", 0, 0), ("u2", 0, 1), ("u3", 1, 1), ("u4", 2, 0), ("u9", 0, 0),
    ]
    assert sorted(map(tuple, R.keep_first_by_url(once).collect())) == sorted(map(tuple, once.collect()))


def test_merge_prefers_held(items):
    merged = R.merge_batches(items.filter("batch > 0"), items.filter("batch = 0"))
    assert sorted((r["url"], r["batch"]) for r in merged.collect()) == [("u1", 1), ("u2", 0), ("u3", 1), ("u4", 2), ("u9", 0)]


def test_cumulative(items):
    rows = {(r["author"], r["batch"]): (r["new_items"], r["total_items"], r["is_read"]) for r in R.cumulative_batches(items, 3).collect()}
    assert rows == {("a", 0): (2, 2, True), ("a", 1): (1, 3, True), ("a", 2): (1, 4, False), ("b", 0): (1, 1, True)}
    kept = R.cumulative_until_limit(items, 3)
    assert sorted(r["url"] for r in kept.collect()) == ["u1", "u2", "u3", "u9"]


def test_requests(spark):
    schema = "author_url string, max_posts int, requests_per_second double, output_format string, sort_by string, tags array<string>, date_range struct<start:string,end:string>"
    frame = spark.createDataFrame(
        [
            ("https://medium.com/@u", 5, 1.0, "json", "latest", ["a"], ("2024-01-01", "January 5, 2024")),
            ("https://medium.com/@u", None, None, None, None, None, None),
            ("nope", 0, 9.0, "xml", "best", [" "], ("soon", "x")),
            (None, 1001, 0.0, "csv", "oldest", [], ("2024-02-01", "2024-01-01")),
            ("https://other.org/@u", 1, 0.1, "xlsx", "popular", [], None),
        ],
        schema,
    )
    rows = [r["errors"] for r in Q.validate_requests(frame).collect()]
    assert rows[0] == [] and rows[1] == []
    assert len(rows[2]) == 8 and rows[2][0] == "Author URL must be a valid URL format"
    assert rows[3] == [
        "Author URL is required and must be a string", "maxPosts must be a number between 1 and 1000",
        "requestsPerSecond must be a number between 0.1 and 5", "dateRange.start must be before dateRange.end",
    ]
    assert len(rows[4]) == 1


@pytest.mark.parametrize(
    "url,kind,strict",
    [
        ("https://medium.com/@u", "author", "author"),
        ("https://medium.com/p/abc", "article", "article"),
        ("https://medium.com/@u/slug-0123456789ab", "author", "article"),
        ("https://medium.com/about", "unknown", "unknown"),
    ],
)
def test_page_type(evaluate, url, kind, strict):
    assert evaluate(Q.page_type, [(url,)], "u string") == [kind]
    assert evaluate(lambda u: Q.page_type(u, strict=True), [(url,)], "u string") == [strict]


def test_stats_of_nothing(spark):
    nothing = spark.createDataFrame([], "has_barrier boolean, is_error boolean, scraped_at timestamp")
    row = stats.run_stats(nothing).first()
    assert (row["total_articles"], row["session_duration"], float(row["success_rate"])) == (0, 0, 0.0)


def test_skipped_pages_count(spark):
    rows = spark.createDataFrame(
        [(True, False, None), (False, False, None), (False, True, None)], "has_barrier boolean, is_error boolean, scraped_at timestamp"
    )
    row = stats.run_stats(rows).first()
    assert (row["total_articles"], row["paywall_hits"], row["successful_extractions"], row["errors"]) == (3, 1, 1, 1)
    assert (float(row["paywall_rate"]), float(row["success_rate"])) == (33.33, 33.33)
