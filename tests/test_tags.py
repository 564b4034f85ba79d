"""The tag pass in Arrow batches: the same elements as the native pass, and each page cut outside of row expressions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import html as H, tags, text as X
from foliolens.operators import barrier, markup as M, state as S
from foliolens.plans.queries import QUERIES

PAGES = [
    "<div data-testid='articleContent'>a<div>b</div></div><DIV Data-TestID=articleBody >c",
    "<ul><li>a<ol><li>b</ol><li>c</ul><blockquote>q<cite>w</cite><blockquote>r", "</a><a href='x'>1<a href=y>2</a><a>3",
    "<pre class='language-x'><code>k</code></pre><img src=a><img alt='b'></img><code>open", "<a:b href='q'>x</a:b><a\n href = \"q\">y</a\t>",
    "<article>1<article>2</article></article><main>m<article>3", "<p class='pw-post-date x'>t</p><é class=y>", "<a", "", None,
    "<li>kK</li><a HREF='/@u'>\U0001f600</a>",
]
CUTS = [
    (V.CONTENT_CONTAINER, {}), (M.ARTICLE_TAG, {"outermost": True}), ((("ul", "", "", ""), ("ol", "", "", "")), {}),
    ((("pre", "", "", ""), ("code", "", "", "")), {}), ((("img", "", "", ""),), {"outermost": True}), ((("img", "", "", ""),), {}),
    ((("a", "href", "*=", ""),), {}), (V.POST_DATE, {"only_first": True}), (V.POST_BOXES, {}), (V.DATE, {}), ((("li", "", "", ""),), {}),
    (barrier._BODY, {"only_first": True}),
]


def test_batches_find_what_the_native_pass_finds(spark):
    pages = spark.createDataFrame([(page,) for page in PAGES], "html string")
    wanted = [H.elements("html", specs, **how).alias(f"native{i}") for i, (specs, how) in enumerate(CUTS)]
    found = [H.page_elements("html", specs, **how).alias(f"found{i}") for i, (specs, how) in enumerate(CUTS)]
    for row in pages.select("html", *wanted, *found).collect():
        for i in range(len(CUTS)):
            assert row[f"found{i}"] == row[f"native{i}"], (row["html"], CUTS[i])


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("build", [
    M.listing, M.page_content, lambda pages: S.assemble_article(pages, F.lit("2024-03-31").cast("timestamp"), include_comments=True),
    lambda pages: barrier.barrier_classify(pages),
])
def test_pages_are_cut_in_batches_alone(spark, build):
    """The native pass sorts the tags of a page inside of row expressions, several times for each kind of element."""
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    plan = plan_of(build(pages))
    assert "ArrowEvalPython" in plan and "array_sort" not in plan.lower()


def test_words_are_counted_on_one_collapsed_text(spark):
    frame = spark.createDataFrame([(" a  b　c ",)], "t string").select(F.transform(F.array("t"), X.word_count)[0].alias("n"))
    assert plan_of(frame).count("regexp_replace") == 1
    assert frame.first()["n"] == 3


@pytest.mark.parametrize("text", ["", None, " ", "　a  ", "a b", "\ta", "a﻿ ", "   "])
def test_ends_are_stripped(evaluate, text):
    wanted = None if text is None else text.strip(X.WS_CHARACTERS)
    assert evaluate(X.trim_ws, [(text,)], "t string") == [wanted]


@pytest.mark.parametrize("options, functions", [({"include_comments": True}, 2), ({"include_content": False}, 1)])
def test_an_article_is_read_by_few_python_functions(spark, options, functions):
    """Each of them has a Python worker of its own in every task, with a batch of pages in it."""
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    plan = plan_of(S.assemble_article(pages, F.lit("2024-03-31").cast("timestamp"), **options))
    assert plan.count("ArrowEvalPython") == functions


def test_a_cut_that_is_not_asked_for_finds_nothing(spark):
    pages = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, wanted boolean")
    cuts = {"links": H.cut_for((("a", "", "", ""),)), "bold": H.cut_for((("b", "", "", ""),))}
    found = pages.select("id", tags.found_in(F.lit("<a>1</a><b>2</b>"), cuts, {"links": F.col("wanted")}).alias("found"))
    assert [(row["id"], *row["found"]) for row in found.orderBy("id").collect()] == [
        (1, ["<a>1</a>"], ["<b>2</b>"]), (2, [], ["<b>2</b>"]), (3, [], ["<b>2</b>"]),
    ]


def test_pages_are_cut_whatever_the_size_of_a_batch(spark):
    sizes = [0, 5, 700_000, 1, 400_000, 400_000, 3, 900_000]
    pages = spark.createDataFrame([(i, f"<p>{'x' * n}</p>" * (n > 0)) for i, n in enumerate(sizes)], "id int, html string").coalesce(1)
    found = pages.select("id", F.size(H.page_elements("html", (("p", "", "", ""),))).alias("n"), F.length("html").alias("length"))
    assert [tuple(row) for row in found.orderBy("id").collect()] == [(i, int(n > 0), n + 7 * (n > 0)) for i, n in enumerate(sizes)]


def test_few_pages_of_a_batch_are_python_objects_at_a_time():
    batch = pa.array(["x" * 100_000] * 50 + [None])
    parts = [rows for (rows,) in tags._parts(batch)]
    assert max(sum(len(row or "") for row in rows) for rows in parts) <= 600_000
    assert [row for rows in parts for row in rows] == batch.to_pylist()
    assert list(tags._parts(pa.array([], pa.string()))) == []


def test_remembered_tags_are_bounded_by_their_length():
    find = tags.Finder(H.cut_for((("a", "href", "*=", ""),)))
    for i in range(200):
        assert len(find("".join(f"<a href='{i}-{j}' title='{'t' * 1000}'>x</a>" for j in range(20)))) == 20
    assert sum(map(len, find.known)) <= 600_000


def test_queries_bound_the_bytes_of_a_batch(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256m")
        QUERIES["scan_pages"](spark, sf_dir)
        assert int(spark.conf.get(name).rstrip("b")) <= 8 * 1024 * 1024
    finally:
        spark.conf.set(name, before)


def test_comments_and_their_fields_come_from_one_python_function(spark):
    comment = "<div data-testid='comment'><a data-testid='commentAuthor' href='/@{0}'>{0}</a><p data-testid='commentContent'>t{0}</p></div>"
    section = f"<section data-testid='responses'>{comment.format('a')}{comment.format('b')}</section>"
    pages = spark.createDataFrame(
        [(1, "https://x.example.com/p/1", section), (2, "https://x.example.com/p/2", comment.format("c")), (3, None, None)],
        "page_id bigint, url string, html string",
    )
    found = M.comments(pages)
    assert plan_of(found).count("ArrowEvalPython") == 1
    assert [(row["page_id"], row["index"], row["author"], row["content"]) for row in found.orderBy("page_id", "index").collect()] == [
        (1, 0, "a", "ta"), (1, 1, "b", "tb"),
    ]
