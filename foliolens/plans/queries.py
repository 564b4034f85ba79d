"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``.

Arrays and structs are flattened to text here, only so that results compare
cell by cell; the operators themselves return typed columns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import dates, html as H, register, text as X
from foliolens.operators import (
    barrier, events as E, exports, keywords, markup as M, relational as R, requests, runs, state as S, stats,
)
from foliolens.plans import flagship
from foliolens.session import BATCHES, new_folder
from foliolens.sources import adapters as A, tables as T
from foliolens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCRAPED_AT = "2024-03-31T00:00:00.000Z"
RANGE = (datetime(2024, 1, 5), datetime(2024, 2, 20))


def named(name: str) -> Callable[[Query], Query]:
    def register_query(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in {"spark.sql.session.timeZone": "UTC", **BATCHES}.items():
                spark.conf.set(key, value)
            return build(spark, folder)

        QUERIES[name] = run
        return run

    return register_query


def query(build: Query) -> Query:
    return named(build.__name__)(build)


def now() -> Column:
    return F.lit("2024-03-31 00:00:00").cast("timestamp")


def joined(items: X.ColumnOrName, separator: str = "|") -> Column:
    return F.array_join(X.as_column(items), separator)


def fields(items: X.ColumnOrName, *names: str) -> Column:
    """An array of structs as one text: fields by ``~``, entries by ``|``."""
    return joined(
        F.transform(items, lambda item: F.concat_ws("~", *[item[name].cast("string") for name in names]))
    )


def iso(column: X.ColumnOrName) -> Column:
    return dates.iso_format(column)


def table(spark, folder, name):
    return T.scan_table(spark, folder, name)


def documents(spark, folder):
    return table(spark, folder, "documents")


def articles(spark, folder, **from_text):
    return A.articles(documents(spark, folder), table(spark, folder, "labels"), **from_text)


def unflagged(spark, folder, **from_text):
    """Articles where the premium flag is not needed."""
    return A.articles(documents(spark, folder), **from_text)


def listing(spark, folder):
    return A.listing(documents(spark, folder))


def comments_of(spark, folder):
    return A.comments(table(spark, folder, "conversations"))


def with_words(spark, folder, **extra):
    words = X.word_count("text")
    rows = articles(spark, folder, word_count=words, **extra)
    return rows.withColumn("read_time", X.minutes_for_words("word_count"))


def reached(spark, folder):
    """Articles that were actually visited: those with a label."""
    visited = table(spark, folder, "labels").select(F.col("doc_id").alias("article_id"))
    return articles(spark, folder).join(visited, "article_id", "left_semi")


def brief(rows: DataFrame, *more) -> DataFrame:
    return rows.select("article_id", "author", "url", iso("published_at").alias("published_at"), *more)


def as_doubles(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("double") for name in names})


# --- sources -----------------------------------------------------------------------


@query
def scan_pages(spark, folder):
    return T.scan_pages(spark, folder).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def scan_results(spark, folder):
    rows = unflagged(spark, folder).select("article_id", "author", "claps")
    path = new_folder(spark, "results")
    posted = rows.filter(F.col("article_id") % 7 != 0)
    authors = rows.filter(F.col("article_id") % 7 == 0)
    exports.sink_append(exports.as_results(posted, "article", SCRAPED_AT), path)
    exports.sink_append(exports.as_results(authors, "author", SCRAPED_AT), path)
    stored = T.scan_results(spark, path)

    def told(part: DataFrame, kind: str) -> DataFrame:
        return part.select(
            F.lit(kind).alias("kind"),
            F.variant_get("data", "$.article_id", "bigint").alias("article_id"),
            F.variant_get("data", "$.author", "string").alias("author"),
        )

    return told(T.article_results(stored), "article").unionByName(told(T.first_author(stored), "author"))


@query
def scan_requests(spark, folder):
    path = new_folder(spark, "requests")
    A.job_requests(T.scan_pages(spark, folder)).drop("page_id").write.json(path)
    return T.scan_requests(spark, path).select(
        "author_url", F.col("max_posts").cast("bigint").alias("max_posts"), "include_content",
        joined("tags").alias("tags"), "requests_per_second", "output_format",
        F.col("date_range.start").alias("range_start"), F.col("date_range.end").alias("range_end"), "sort_by",
    )


@query
def scan_events(spark, folder):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return T.scan_events(spark, folder).select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value", "props"
    )


@query
def paginate(spark, folder):
    return brief(R.paginate_by_place(unflagged(spark, folder), 40, 20))


# --- exports -----------------------------------------------------------------------


@query
def sink_append(spark, folder):
    path = new_folder(spark, "records")
    for kind, rows in (
        ("article", unflagged(spark, folder).select("article_id", "title", "claps")),
        ("comment", comments_of(spark, folder).select("article_id", "author", "claps")),
    ):
        exports.sink_append(exports.as_results(rows, kind, SCRAPED_AT), path)
    return T.scan_results(spark, path).select(
        "type",
        F.variant_get("data", "$.article_id", "bigint").alias("article_id"),
        F.variant_get("data", "$.claps", "bigint").alias("claps"),
        iso("scraped_at").alias("scraped_at"),
    )


@query
def sink_json(spark, folder):
    path = new_folder(spark, "json")
    exports.sink_json(articles(spark, folder).select("article_id", "title", "tags", "is_premium", "published_at"), path)
    schema = "article_id bigint, title string, tags array<string>, is_premium boolean, published_at timestamp"
    back = spark.read.schema(schema).json(path)
    return back.select("article_id", "title", joined("tags").alias("tags"), "is_premium", iso("published_at").alias("published_at"))


def export_articles(spark, folder):
    rows = with_words(
        spark, folder,
        keywords=X.keywords("text"), hashtags=X.hashtags("text"), mentions=X.mentions("text"),
        preview=exports.preview("text"),
    )
    return R.article_comments(rows, comments_of(spark, folder))


@query
def export_rows(spark, folder):
    return exports.export_rows(export_articles(spark, folder), SCRAPED_AT)


def export_summary(spark, folder):
    outcomes = articles(spark, folder).select(
        F.col("is_premium").alias("has_barrier"), F.lit(False).alias("is_error"),
        F.col("published_at").alias("scraped_at"),
    )
    totals = stats.run_stats(outcomes).withColumns(
        {"author_name": F.lit("All"), "author_url": F.lit(None).cast("string")}
    )
    return exports.summary_row(totals, SCRAPED_AT)


@query
def export_with_summary(spark, folder):
    rows = exports.export_rows(with_words(spark, folder, preview=exports.preview("text")), SCRAPED_AT)
    return exports.export_with_summary(rows, export_summary(spark, folder))


@query
def rows_plus_summary(spark, folder):
    rows = exports.export_rows(articles(spark, folder), SCRAPED_AT)
    both = exports.export_with_summary(rows, export_summary(spark, folder))
    return both.groupBy("row_kind").agg(
        F.count("*").alias("n"), F.max("Word Count").alias("last_words"),
        F.max("Content Summary").alias("last_summary"),
    )


@query
def sink_csv(spark, folder):
    rows = exports.export_rows(with_words(spark, folder, preview=exports.preview("text")), SCRAPED_AT, "article_id")
    path = new_folder(spark, "csv")
    exports.sink_csv(rows, path)
    return exports.csv_line(exports.read_csv(spark, path, rows.columns), "article_id").withColumn(
        "article_id", F.col("article_id").cast("bigint")
    )


@query
def html_report_rows(spark, folder):
    return exports.html_report_row(with_words(spark, folder))


@query
def public_shape(spark, folder):
    rows = with_words(spark, folder, content=X.clean_text("text"))
    rows = rows.withColumns({"publication": F.lit(None).cast("struct<name:string>"), "scraped_at": F.lit(SCRAPED_AT)})
    return exports.public_articles(rows).withColumn("tags", joined("tags"))


@query
def public_comments(spark, folder):
    return exports.public_comments(comments_of(spark, folder)).select(
        "article_id", "comments_part", fields("comments", "user", "comment", "likes").alias("comments")
    )


@query
def public_stats(spark, folder):
    return exports.public_stats(documents(spark, folder), comments_of(spark, folder), "0 seconds")


@query
def export_slug(spark, folder):
    named = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.col("source"), F.lit(": A/B  "), F.col("lang")))
    wanted = F.when(F.col("doc_id") % 4 == 0, "CSV").when(F.col("doc_id") % 4 == 1, "xlsx").otherwise("pdf")
    return documents(spark, folder).select(
        "doc_id",
        exports.file_stem(named, F.coalesce(iso(A.published_at()), F.lit(SCRAPED_AT))).alias("stem"),
        exports.export_format(wanted).alias("format"),
    )


@query
def sink_by_author(spark, folder):
    path = new_folder(spark, "by-author")
    exports.sink_by_author(unflagged(spark, folder).select("article_id", "author", "claps"), path)
    back = spark.read.schema("article_id bigint, author string, claps bigint, author_slug string").json(path)
    return back.select("article_id", "author", "claps", "author_slug")


@query
def metric_value(spark, folder):
    return E.metric_value(E.event_counters(T.scan_events(spark, folder)))


# --- page extraction ------------------------------------------------------------------


def block_pages(spark, folder):
    return A.block_pages(documents(spark, folder))


def content_part(spark, folder, build, pages=None):
    """One kind of block from all content containers of every page, in page order."""
    pages = block_pages(spark, folder) if pages is None else pages
    found = pages.select("page_id", "url", M.content_containers(H.without_code("html")).alias("boxes"))
    return found.select("page_id", F.flatten(F.transform("boxes", build)).alias("found"))


def shown_part(spark, folder, build, show, pages=None):
    return content_part(spark, folder, build, pages).select("page_id", show(F.col("found")).alias("found"))


def state_pages(spark, folder):
    return A.state_pages(documents(spark, folder))


@query
def embedded_state(spark, folder):
    found = state_pages(spark, folder).select("page_id", S.embedded_state(F.col("html")).alias("state"))
    return found.select(
        "page_id", F.col("state").isNotNull().alias("has_state"),
        S.state_map(F.col("state")).isNotNull().alias("is_valid"),
    )


@query
def state_ref_lookup(spark, folder):
    found = state_pages(spark, folder).select(
        "page_id", S.state_map(S.embedded_state(F.col("html"))).alias("records")
    )
    keys = X.exploded(found, ["page_id"], F.array(S.post_key(F.col("records"))), "_", "post_key")
    return keys.filter(F.col("post_key").isNotNull()).drop("_")


def flat_article(rows: DataFrame) -> DataFrame:
    a = F.col("article")
    return rows.select(
        "page_id", *[a[name].alias(name) for name in ("title", "subtitle", "author", "author_url")],
        iso(a["published_at"]).alias("published_at"), a["read_time"].alias("read_time"),
        a["claps"].alias("claps"), a["responses"].alias("responses"), joined(a["tags"]).alias("tags"),
        a["publication"]["name"].alias("publication_name"), a["publication"]["url"].alias("publication_url"),
        a["main_image"].alias("main_image"), a["is_premium"].alias("is_premium"), a["url"].alias("url"),
        a["series"]["name"].alias("series_name"), a["series"]["url"].alias("series_url"),
        a["series"]["part"].alias("series_part"),
    )


@query
def state_article(spark, folder):
    found = S.usable_state(S.state_pages(state_pages(spark, folder)))
    return flat_article(found.select("page_id", S.state_article(F.col("post"), F.col("url"), now()).alias("article")))


@query
def markup_article(spark, folder):
    return flat_article(M.markup_article(block_pages(spark, folder), now()))


@query
def article_info(spark, folder):
    return flat_article(S.article_info(state_pages(spark, folder), now()))


@query
def state_blocks(spark, folder):
    blocks = S.state_blocks(state_pages(spark, folder))
    placed = X.exploded(blocks, ["page_id"], F.col("blocks"), "position", "b")
    return placed.select(
        "page_id", "position", "b.type",
        F.col("b.level").cast("bigint").alias("level"), "b.text", "b.language", "b.code", "b.src", "b.alt",
        "b.list_type", joined("b.items").alias("items"),
    )


@query
def state_content(spark, folder):
    c = F.col("content")
    return S.state_content(state_pages(spark, folder)).select(
        "page_id", c["text_content"].alias("text_content"), fields(c["headings"], "level", "text").alias("headings"),
        joined(c["paragraphs"]).alias("paragraphs"), fields(c["quotes"], "text", "author").alias("quotes"),
        fields(c["code_blocks"], "language", "code").alias("code_blocks"), fields(c["images"], "src", "alt").alias("images"),
        F.size(c["lists"]).cast("bigint").alias("n_lists"), c["word_count"].alias("word_count"),
    )


@query
def headings(spark, folder):
    return shown_part(spark, folder, M.headings, lambda found: fields(found, "level", "text"))


@query
def page_headings(spark, folder):
    return shown_part(
        spark, folder, M.headings, lambda found: fields(found, "level", "text"), T.scan_pages(spark, folder)
    )


@query
def paragraphs(spark, folder):
    found = content_part(spark, folder, H.paragraph_texts, T.scan_pages(spark, folder))
    return X.exploded(found, ["page_id"], F.col("found"), "position", "paragraph")


def flat_lists(items: Column) -> Column:
    return joined(
        F.transform(items, lambda lst: F.concat(lst["type"], F.lit(":"), joined(lst["items"], "~")))
    )


@query
def lists(spark, folder):
    return shown_part(spark, folder, M.lists, flat_lists)


@query
def page_lists(spark, folder):
    found = T.scan_pages(spark, folder).select("page_id", M.lists(H.without_code("html")).alias("found"))
    return found.select("page_id", flat_lists(F.col("found")).alias("found"))


@query
def quotes(spark, folder):
    return shown_part(spark, folder, M.quotes, lambda found: fields(found, "text", "author"))


@query
def code_blocks(spark, folder):
    return shown_part(spark, folder, M.code_blocks, lambda found: fields(found, "language", "code"))


@query
def images(spark, folder):
    return shown_part(spark, folder, M.images, lambda found: fields(found, "src", "alt", "caption"))


@query
def links(spark, folder):
    return shown_part(
        spark, folder, lambda box: M.links(box, F.col("url")), lambda found: fields(found, "text", "url", "title")
    )


@query
def page_links(spark, folder):
    found = T.scan_pages(spark, folder).select(
        "page_id", M.links(H.without_code("html"), F.col("url")).alias("found")
    )
    return found.select("page_id", fields("found", "text", "url", "title").alias("found"))


@query
def markup_content(spark, folder):
    contents = M.markup_content(T.scan_pages(spark, folder))
    placed = X.exploded(contents, ["page_id", "contents"], F.col("contents"), "container", "c")
    c = F.col("c")
    return placed.select(
        "page_id", "container", F.size("contents").cast("bigint").alias("n_containers"),
        fields(c["headings"], "level", "text").alias("headings"),
        F.size(c["paragraphs"]).cast("bigint").alias("n_paragraphs"),
        F.size(c["links"]).cast("bigint").alias("n_links"), c["word_count"].alias("word_count"),
    )


@query
def flatten_content(spark, folder):
    c = F.col("content")
    return M.page_content(T.scan_pages(spark, folder)).select(
        "page_id", c["text_content"].alias("text_content"), joined(c["paragraphs"]).alias("paragraphs"),
        c["word_count"].alias("word_count"),
    )


@query
def concat_fragments(spark, folder):
    """Every line of a document as its own container, merged again."""
    pages = documents(spark, folder).select(
        F.col("doc_id").alias("page_id"), A.article_url("source", "doc_id").alias("url"),
        F.array_join(
            F.transform(
                A.lines("text"), lambda line: F.concat(F.lit("<article><p>"), X.html_escape(line), F.lit("</p></article>"))
            ),
            "",
        ).alias("html"),
    )
    c = F.col("content")
    return M.page_content(pages).select(
        "page_id", F.size(c["paragraphs"]).cast("bigint").alias("n_paragraphs"), c["text_content"].alias("text_content"),
        c["word_count"].alias("word_count"),
    )


@query
def comments(spark, folder):
    return M.comments(A.comment_pages(table(spark, folder, "conversations"))).drop("url")


@query
def publication(spark, folder):
    return M.publication(block_pages(spark, folder)).select("page_id", "publication.*")


def author_pages(spark, folder):
    return A.author_pages(documents(spark, folder))


@query
def author_profile(spark, folder):
    return M.author_profile(author_pages(spark, folder))


@query
def author_links(spark, folder):
    return M.author_links(author_pages(spark, folder)).select(
        "page_id", fields("social_links", "platform", "url").alias("social_links"),
        fields("publications", "name", "url", "role").alias("publications"),
    )


@named("listing")
def listing_items(spark, folder):
    return M.listing(author_pages(spark, folder))


@query
def page_census(spark, folder):
    return M.page_census(T.scan_pages(spark, folder)).withColumn("first_links", fields("first_links", "href", "text"))


@query
def body_text_cascade(spark, folder):
    return M.body_text_cascade(T.scan_pages(spark, folder))


@query
def assemble_article(spark, folder):
    pages = block_pages(spark, folder).withColumn("page_id", F.col("page_id") * 2).unionByName(
        state_pages(spark, folder).withColumn("page_id", F.col("page_id") * 2 + 1)
    )
    rows = S.assemble_article(pages, now(), include_comments=True)
    return rows.select(
        "page_id", "article.title", "article.claps", F.col("content.word_count").alias("word_count"),
        F.size("content.paragraphs").cast("bigint").alias("n_paragraphs"),
        F.size("comments").cast("bigint").alias("n_comments"), F.col("publication.name").alias("publication"),
    )


# --- scalar functions ---------------------------------------------------------------


def per_document(spark, folder, **columns):
    return documents(spark, folder).select("doc_id", *[c.alias(name) for name, c in columns.items()])


KEY = "doc_id"


@query
def clean_text(spark, folder):
    return per_document(spark, folder, cleaned=X.clean_text("text"))


@query
def word_count(spark, folder):
    return per_document(spark, folder, words=X.word_count("text"))


@query
def reading_minutes(spark, folder):
    key = F.col(KEY)
    number = key.cast("string")
    told = (
        F.when(key % 6 == 0, F.concat(number, F.lit(" min read")))
        .when(key % 6 == 1, F.concat(number, F.lit("  Hours")))
        .when(key % 6 == 2, F.concat(F.lit("1 hr "), number, F.lit(" min")))
        .when(key % 6 == 3, F.concat(F.lit("about "), number, F.lit("minute")))
        .when(key % 6 == 4, F.concat(number, F.lit(" h")))
    )
    return per_document(spark, folder, minutes=X.reading_minutes(told))


@query
def estimate_minutes(spark, folder):
    return per_document(spark, folder, minutes=X.estimate_minutes("text"))


def dated_texts() -> Column:
    key = F.col(KEY)
    day = A.published_at()
    number = (key % 400).cast("string")
    return (
        F.when(key % 8 == 0, F.concat(F.lit("Published "), F.date_format(day, "MMMM d, yyyy")))
        .when(key % 8 == 1, F.date_format(day, "d MMM yyyy"))
        .when(key % 8 == 2, F.date_format(day, "M/d/yyyy"))
        .when(key % 8 == 3, F.date_format(day, "yyyy-M-d"))
        .when(key % 8 == 4, iso(day))
        .when(key % 8 == 5, F.concat(number, F.lit(" days ago")))
        .when(key % 8 == 6, F.concat(number, F.lit(" months ago")))
        .otherwise("soon")
    )


@query
def parse_article_date(spark, folder):
    return per_document(spark, folder, parsed=iso(dates.parse_article_date(dated_texts(), now())))


@query
def iso_date(spark, folder):
    return per_document(spark, folder, parsed=dates.iso_date(dated_texts(), now()))


@query
def file_slug(spark, folder):
    return per_document(spark, folder, slug=X.file_slug("text"))


@query
def truncate(spark, folder):
    return per_document(spark, folder, short=X.truncate("text", 80), tiny=X.truncate("text", 2))


@query
def hashtags(spark, folder):
    marked = F.replace(F.col("text"), F.lit(" "), F.lit(" #"))
    return per_document(spark, folder, hashtags=joined(X.hashtags(marked)))


@query
def mentions(spark, folder):
    return per_document(spark, folder, mentions=joined(X.mentions("text")), n=F.size(X.mentions("text")).cast("bigint"))


@query
def domain(spark, folder):
    return T.scan_pages(spark, folder).select(
        "page_id", X.domain("url").alias("domain"),
        X.domain(F.regexp_replace("url", "://", "://WWW.")).alias("www_domain"),
        X.domain(F.regexp_replace("url", "^.*://", "")).alias("no_domain"),
    )


@query
def is_valid_url(spark, folder):
    return T.scan_pages(spark, folder).select(
        "page_id", X.is_valid_url("url").alias("is_valid"),
        X.is_valid_url(F.regexp_replace("url", "^.*://", "")).alias("without_scheme"),
    )


@query
def plain_text(spark, folder):
    rows = M.page_content(block_pages(spark, folder)).select("page_id", "content")
    return rows.select("page_id", X.plain_text("content", F.lit("T"), F.lit("")).alias("plain_text"))


@query
def summary(spark, folder):
    return per_document(spark, folder, summary=X.summary("text"))


@query
def digits_count(spark, folder):
    told = F.concat(F.format_number(F.col(KEY) * 977, 0), F.lit(" claps"))
    return per_document(
        spark, folder, plain=X.digits_count(told), short=X.digits_count(F.concat((F.col(KEY) % 10).cast("string"), F.lit(".5K"))),
        none=X.digits_count("lang"),
    )


@query
def suffix_count(spark, folder):
    number = F.concat((F.col(KEY) % 1000).cast("string"), F.lit("."), (F.col(KEY) % 10).cast("string"))
    return per_document(
        spark, folder, thousands=X.suffix_count(F.concat(number, F.lit("K"))),
        millions=X.suffix_count(F.concat(number, F.lit("M followers"))),
        plain=X.suffix_count(F.format_number(F.col(KEY) * 977, 0)),
    )


@query
def contains_ci_either(spark, folder):
    return per_document(
        spark, folder, text_lang=X.contains_ci_either("text", F.upper("lang")),
        lang_source=X.contains_ci_either("lang", F.concat(F.col("source"), F.lit("-FR"))),
    )


@query
def html_escape(spark, folder):
    return per_document(spark, folder, escaped=X.html_escape("text"))


@query
def csv_escape(spark, folder):
    return per_document(spark, folder, escaped=X.csv_escape(F.replace(F.col("text"), F.lit(" "), F.lit('"'))))


@query
def engagement(spark, folder):
    return per_document(spark, folder, engagement=X.engagement(A.claps(), A.responses()))


# --- filters, routing, requests --------------------------------------------------------


@query
def page_type(spark, folder):
    key = F.col(KEY)
    hex_id = F.lpad(F.lower(F.hex(key)), 12, "0")
    base = F.lit("https://medium.com/")
    url = (
        F.when(key % 7 == 0, F.concat(base, F.lit("@"), F.col("source")))
        .when(key % 7 == 1, F.concat(base, F.lit("p/"), hex_id))
        .when(key % 7 == 2, F.concat(base, F.lit("@"), F.col("source"), F.lit("/slug-"), hex_id))
        .when(key % 7 == 3, F.concat(base, F.lit("about")))
        .when(key % 7 == 4, F.concat(F.lit("https://x.org/story/"), hex_id))
        .when(key % 7 == 5, F.concat(base, F.lit("some-long-slug")))
        .otherwise(F.concat(F.lit("https://x.org/@u/"), hex_id))
    )
    return per_document(
        spark, folder, page_type=requests.page_type(url), strict_type=requests.page_type(url, strict=True)
    )


@query
def filter_tags(spark, folder):
    return brief(R.filter_tags(unflagged(spark, folder), ["FRA", "SRC1"]))


@query
def filter_dates(spark, folder):
    return brief(R.filter_dates(unflagged(spark, folder), *RANGE))


@query
def filter_premium(spark, folder):
    return brief(R.filter_premium(articles(spark, folder)))


@query
def filter_read_time(spark, folder):
    rows = unflagged(spark, folder, word_count=X.word_count("text"))
    rows = rows.withColumn("read_time", X.minutes_for_words("word_count"))
    return brief(R.filter_read_time(rows, 2, 6), "read_time")


@query
def require_title_url(spark, folder):
    rows = unflagged(spark, folder).withColumn("title", F.when(F.col("article_id") % 5 > 0, F.col("title")).otherwise(""))
    rows = rows.withColumn("url", F.when(F.col("article_id") % 7 > 0, F.col("url")))
    return M.require_title_url(rows).select("article_id", "title", "url")


def barrier_pages(spark, folder):
    return A.barrier_pages(documents(spark, folder))


@query
def barrier_classify(spark, folder):
    rows = barrier.barrier_classify(barrier_pages(spark, folder))
    return rows.select("page_id", "has_barrier", "barrier_type", joined("indicators").alias("indicators"), "confidence")


@query
def barrier_classify_compat(spark, folder):
    rows = barrier.barrier_classify(barrier_pages(spark, folder), compat=True)
    return rows.select("page_id", "has_barrier", "barrier_type", joined("indicators").alias("indicators"), "confidence")


@query
def barrier_skip(spark, folder):
    return barrier.barrier_skip(barrier.barrier_classify(T.scan_pages(spark, folder))).select("page_id", "url")


@query
def validate_requests(spark, folder):
    rows = requests.validate_requests(A.job_requests(T.scan_pages(spark, folder)), site="example.com")
    return rows.select("page_id", joined("errors").alias("errors"), "is_valid")


@query
def validate_json_requests(spark, folder):
    rows = requests.read_requests(A.json_requests(T.scan_pages(spark, folder)))
    checked = requests.validate_requests(rows, site="example.com")
    return checked.select("page_id", joined("errors").alias("errors"), "is_valid")


@query
def normalise_requests(spark, folder):
    rows = requests.normalise_requests(A.job_requests(T.scan_pages(spark, folder)))
    return rows.select(
        "page_id", "author_url", F.col("max_posts").cast("bigint").alias("max_posts"), "include_content",
        "include_comments", "include_publication", joined("tags").alias("tags"), "requests_per_second",
        "use_proxy", "output_format", "premium_content", "sort_by",
    )


# --- relationships ----------------------------------------------------------------------


@query
def state_deref(spark, folder):
    return S.state_deref(state_pages(spark, folder)).select(
        "page_id", "from_key", "position", "key", F.get_json_object("record", "$.type").alias("record_type"),
    )


@query
def listing_to_article(spark, folder):
    found = R.listing_to_article(
        listing(spark, folder), reached(spark, folder).select("url", "article_id", "claps", "is_premium")
    )
    return found.select("url", "batch", "index", "article_id", "claps", "is_premium")


@query
def not_reached(spark, folder):
    return R.not_reached(listing(spark, folder), reached(spark, folder)).select("url", "index")


@query
def tags_backfill(spark, folder):
    filled = R.tags_backfill(listing(spark, folder), reached(spark, folder))
    return R.filter_tags(filled, ["de"]).select("url", joined("tags").alias("tags"), "claps", "responses", "is_premium")


@query
def article_comments(spark, folder):
    return R.article_comments(unflagged(spark, folder), comments_of(spark, folder)).select("article_id", "comments_count")


@query
def commented_articles(spark, folder):
    return R.commented_articles(unflagged(spark, folder), comments_of(spark, folder)).select("article_id", "url")


@query
def author_articles(spark, folder):
    rows = R.author_articles(unflagged(spark, folder), ("article_id", "claps"), 20)
    return rows.select("author", "part", "total_articles", fields("articles", "article_id", "claps").alias("articles"))


# --- statistics -----------------------------------------------------------------------


@query
def run_stats(spark, folder):
    return as_doubles(flagship.page_run_stats(T.scan_pages(spark, folder)), "paywall_rate", "success_rate")


def stored_run(spark, folder, premium_content):
    """A run over all pages made from documents: its stored envelopes and its totals."""
    scraped_at = F.timestamp_seconds(F.lit(A.EPOCH) + F.col("page_id"))
    envelopes = runs.run_envelopes(A.run_pages(documents(spark, folder)), now(), scraped_at, premium_content)
    path = new_folder(spark, "run")
    totals = runs.page_run(envelopes, path)
    return runs.read_run(spark, path, envelopes), totals


@query
def page_run(spark, folder):
    stored, _ = stored_run(spark, folder, premium_content=True)
    return exports.export_rows(runs.run_articles(stored), SCRAPED_AT)


@query
def page_run_hosts(spark, folder):
    stored, _ = stored_run(spark, folder, premium_content=False)
    return as_doubles(runs.host_stats(stored), "paywall_rate", "success_rate")


@query
def page_run_csv(spark, folder):
    """A run as a CSV document with its statistics line, read back."""
    stored, totals = stored_run(spark, folder, premium_content=True)
    path = new_folder(spark, "run-csv")
    exports.sink_csv_report(
        exports.export_rows(runs.run_articles(stored), SCRAPED_AT), path,
        lambda _: runs.summary_of(totals, "All", None, SCRAPED_AT),
    )
    return exports.read_framed(spark, path)


@query
def public_run(spark, folder):
    """The articles of a run under public names, with their comments and the run's public totals."""
    stored, totals = stored_run(spark, folder, premium_content=True)
    told = {name: F.lit(value) for name, value in runs.public_totals(totals).items()}
    rows = runs.public_articles(stored).withColumns(told)
    return rows.withColumns(
        {
            "tags": joined("tags"), "comments": fields("comments", "user", "comment", "likes"), "scraped_at": iso("scraped_at"),
            "total_articles_scraped": F.col("total_articles_scraped").cast("bigint"),
            "total_comments_scraped": F.col("total_comments_scraped").cast("bigint"),
        }
    )


@query
def export_stats_told(spark, folder):
    rows = R.article_comments(with_words(spark, folder), comments_of(spark, folder))
    return stats.export_stats(rows, ("is_premium",), "CSV", SCRAPED_AT)


@query
def sink_html(spark, folder):
    """The report of all articles as a framed document, read back."""
    path = new_folder(spark, "report")

    def rates(counted):
        n, hits = counted["n_lines"], counted["hits"]
        return {
            "total_articles": n, "success_rate": runs.percent_text(n - hits, n), "paywall_rate": runs.percent_text(hits, n),
        }

    rows = with_words(spark, folder)
    exports.sink_html_report(rows, path, "All", SCRAPED_AT, rates, hits=F.count_if("is_premium"))
    return exports.read_framed(spark, path)


@query
def barrier_stats(spark, folder):
    rows = barrier.barrier_classify(A.barrier_pages(documents(spark, folder)))
    return as_doubles(stats.barrier_stats(rows), "paywall_rate")


@query
def export_stats(spark, folder):
    rows = R.article_comments(with_words(spark, folder), comments_of(spark, folder))
    return stats.export_stats(rows, ("author",))


@query
def author_totals(spark, folder):
    kept = R.tag_matches("tags", ["en"]) & ~F.col("is_premium")
    return R.author_totals(articles(spark, folder), kept)


@query
def keyword_counts(spark, folder):
    return keywords.keyword_counts(documents(spark, folder))


@query
def event_counters(spark, folder):
    return as_doubles(E.event_counters(T.scan_events(spark, folder)), "success_rate")


@query
def source_success(spark, folder):
    labelled = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    attempts = documents(spark, folder).select("doc_id", "source").join(labelled, "doc_id", "left")
    return as_doubles(stats.source_success(attempts), "success_rate")


@query
def comment_totals(spark, folder):
    return stats.comment_totals(comments_of(spark, folder))


# --- windows, order, sets ---------------------------------------------------------------


@query
def keywords_topk(spark, folder):
    return keywords.keywords_topk(documents(spark, folder))


@query
def keep_first_by_url(spark, folder):
    return R.keep_first_by_url(listing(spark, folder)).select("url", "batch", "index", "author")


@query
def item_index(spark, folder):
    return R.item_index(documents(spark, folder).select("doc_id", A.lines("text").alias("lines")), "lines", "line")


@query
def cumulative_batches(spark, folder):
    return R.cumulative_batches(listing(spark, folder), 3)


@query
def cumulative_until_limit(spark, folder):
    return R.cumulative_until_limit(listing(spark, folder), 3).select("url", "author", "batch", "index")


@query
def sort_latest(spark, folder):
    return brief(R.sorted_articles(unflagged(spark, folder), "latest"))


@query
def sort_oldest(spark, folder):
    return brief(R.sorted_articles(unflagged(spark, folder), "oldest"))


@query
def sort_popular(spark, folder):
    return brief(R.sorted_articles(unflagged(spark, folder), "popular"), "claps", "responses")


@query
def limit_posts(spark, folder):
    return brief(R.limit_posts(unflagged(spark, folder), 100, "popular"))


@query
def limit_posts_per_author(spark, folder):
    return brief(R.limit_posts(unflagged(spark, folder), 3, "oldest", per=("author",), rank="rank"), F.col("rank").cast("bigint").alias("rank"))


@query
def filter_sort_limit(spark, folder):
    return flagship.filter_sort_limit(spark, folder)


@query
def newest_long_articles(spark, folder):
    return flagship.newest_long_articles(spark, folder)


@query
def merge_batches(spark, folder):
    rows = listing(spark, folder)
    merged = R.merge_batches(rows.filter("batch < 2"), rows.filter("batch >= 2"))
    return merged.select("url", "batch", "index")


# --- streaming --------------------------------------------------------------------------


@query
def stream_dedupe(spark, folder):
    stream = T.stream_events(spark, folder).select(
        F.concat(F.lit(f"{A.ORIGIN}/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url"), "ts"
    )
    return jobs.stream_dedupe(stream, new_folder(spark, "dedupe")).select("url")


@query
def session_stats(spark, folder):
    return flat_sessions(E.session_stats(T.scan_events(spark, folder)))


def flat_sessions(rows: DataFrame) -> DataFrame:
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return as_doubles(rows, "success_rate").withColumns(
        {name: F.date_format(name, micros) for name in ("session_start", "session_end")}
    )


@query
def stream_session_stats(spark, folder):
    return flat_sessions(jobs.stream_session_stats(T.stream_events(spark, folder), new_folder(spark, "sessions")))


@query
def rate_audit(spark, folder):
    return E.rate_audit(T.scan_events(spark, folder), 1 / 60).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query
def stream_rate_audit(spark, folder):
    rows = jobs.stream_rate_audit(T.stream_events(spark, folder), new_folder(spark, "rates"), 1 / 60)
    return rows.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query
def stream_counters(spark, folder):
    rows = jobs.stream_counters(T.stream_events(spark, folder), new_folder(spark, "counters"))
    return rows.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm") for name in ("window_start", "window_end")})


@query
def stream_append_results(spark, folder):
    stream = T.stream_events(spark, folder).select(
        F.col("event_type").alias("type"), "event_id", "user_id", "value"
    )
    return jobs.run_available(stream, new_folder(spark, "append"), ("type",))


# --- user functions -------------------------------------------------------------------


@query
def register_functions(spark, folder):
    register.register_functions(spark)
    return documents(spark, folder).selectExpr(
        "doc_id", "fl_clean_text(text) AS cleaned", "fl_word_count(text) AS words",
        "fl_file_slug(text) AS slug", "fl_truncate(text, 80, '...') AS short",
        "array_join(fl_mentions(text), '|') AS mentions", "fl_summary(text, 3) AS summary",
        "fl_html_escape(text) AS escaped", "fl_engagement(doc_id, NULL) AS engagement",
    )


@named("html_blocks")
def list_items(spark, folder):
    return M.html_blocks(T.scan_pages(spark, folder)).withColumn("depth", F.col("depth").cast("bigint"))
