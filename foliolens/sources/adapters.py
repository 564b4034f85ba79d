"""The given tables seen as the relations the operators work on.

Every adapter is a row-wise projection, computed from whole tables and whole
texts.  Text-derived columns are asked for up front so that the text itself never
takes part in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as X

ORIGIN = "https://example.com"
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
ARTICLE_FIELDS = (
    "article_id", "author", "url", "title", "tags", "claps", "responses", "is_premium", "published_at",
)


def article_url(source: X.ColumnOrName, doc_id: X.ColumnOrName) -> Column:
    return F.concat(
        F.lit(f"{ORIGIN}/@"), X.as_column(source), F.lit("/p/"), X.as_column(doc_id).cast("string")
    )


def published_at(doc_id: X.ColumnOrName = "doc_id") -> Column:
    doc_id = X.as_column(doc_id)
    return F.when(doc_id % 97 != 0, F.timestamp_seconds(F.lit(EPOCH) + doc_id * 3600))


def claps(doc_id: X.ColumnOrName = "doc_id") -> Column:
    return (X.as_column(doc_id) * 7919) % 1000


def responses(doc_id: X.ColumnOrName = "doc_id") -> Column:
    return (X.as_column(doc_id) * 104729) % 50


def first_line(text: X.ColumnOrName) -> Column:
    return F.substring_index(X.as_column(text), "\n", 1)


def articles(documents: DataFrame, labels: DataFrame | None = None, **from_text: Column) -> DataFrame:
    """Articles with extra columns computed from ``text`` before the join with labels.

    Without ``labels`` there is no premium flag, and no join.
    """
    documents = X.computed(documents, **from_text) if from_text else documents
    narrow = documents.select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("author"),
        article_url("source", "doc_id").alias("url"),
        first_line("text").alias("title"),
        F.array("lang", "source").alias("tags"),
        claps().alias("claps"),
        responses().alias("responses"),
        published_at().alias("published_at"),
        *from_text,
    )
    if labels is None:
        return narrow
    flags = labels.select(F.col("doc_id").alias("article_id"), (F.col("toxic") == 1).alias("_toxic"))
    joined = narrow.join(flags, "article_id", "left")
    return joined.withColumn("is_premium", F.coalesce("_toxic", F.lit(False))).select(
        *ARTICLE_FIELDS, *from_text
    )


def listing(documents: DataFrame) -> DataFrame:
    """Listed articles without tags and counts; every eleventh is listed in two batches."""
    doc_id = F.col("doc_id")
    batch = doc_id % 5
    batches = F.when(doc_id % 11 == 0, F.array(batch, batch + 1)).otherwise(F.array(batch))
    return documents.select(
        doc_id.alias("index"),
        F.col("source").alias("author"),
        article_url("source", "doc_id").alias("url"),
        first_line("text").alias("title"),
        published_at().alias("published_at"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(0).cast("bigint").alias("claps"),
        F.lit(0).cast("bigint").alias("responses"),
        F.lit(False).alias("is_premium"),
        F.explode(batches).alias("batch"),
    )


def comments(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("article_id"),
        F.col("turn").alias("index"),
        F.col("role").alias("author"),
        F.col("text").alias("content"),
        ((F.col("conv_id") * 31 + F.col("turn")) % 17).alias("claps"),
    )


def _nth(key: Column, *values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def job_requests(pages: DataFrame) -> DataFrame:
    key = F.col("page_id")
    return pages.select(
        "page_id",
        F.col("url").alias("author_url"),
        (key % 1200).cast("int").alias("max_posts"),
        F.when(key % 3 == 0, F.lit(True)).alias("include_content"),
        F.lit(None).cast("boolean").alias("include_comments"),
        F.lit(None).cast("boolean").alias("include_publication"),
        F.when(key % 5 == 0, F.array(F.lit(" AI "), F.lit("")))
        .when(key % 5 == 1, F.array(F.lit("Data")))
        .alias("tags"),
        ((key % 70) / F.lit(10.0)).alias("requests_per_second"),
        F.lit(None).cast("boolean").alias("use_proxy"),
        _nth(key, "json", "csv", "xlsx", "xml").alias("output_format"),
        F.lit(None).cast("boolean").alias("premium_content"),
        F.struct(
            _nth(key, "2024-01-01", "2024-06-01", "soon").alias("start"),
            _nth(key, "2024-03-01", "never").alias("end"),
        ).alias("date_range"),
        _nth(key, "latest", "popular", "oldest", "random").alias("sort_by"),
    )


def json_requests(pages: DataFrame) -> DataFrame:
    """``(page_id, url, input)``: requests as JSON texts, most of them with a fault of type."""
    faults = (
        "", ',"maxPosts":"5"', ',"requestsPerSecond":null', ',"outputFormat":3', ',"sortBy":["latest"]', ',"dateRange":"2024"',
        ',"dateRange":{"start":"soon","end":"2024-01-01"}', ',"tags":"a"', ',"tags":["a",1,""]',
        ',"includeContent":"yes","useProxy":1', None, None,
    )
    key = F.col("page_id")
    whole = F.concat(F.lit('{"authorUrl":'), F.to_json(F.struct("url")).substr(F.lit(8), F.length(F.to_json(F.struct("url"))) - 8), _nth(key, *faults), F.lit("}"))
    return pages.select(
        "page_id", "url", F.when(key % 12 == 10, "null").when(key % 12 == 11, '{"authorUrl":7}').otherwise(whole).alias("input")
    )


def lines(text: X.ColumnOrName) -> Column:
    """Trimmed non-empty lines of a text."""
    return F.filter(
        F.transform(F.split(X.text_or_empty(text), "\n"), lambda line: X.trim_ws(line)), lambda line: line != ""
    )


def _joined(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), "")


def _tag(name: str, attributes: str, *inner) -> Column:
    parts = [F.lit(part) if isinstance(part, str) else part for part in inner]
    return F.concat(F.lit(f"<{name}{' ' if attributes else ''}{attributes}>"), *parts, F.lit(f"</{name}>"))


def _article_head(key: Column) -> Column:
    title = X.html_escape(first_line("text"))
    source = X.html_escape("source")
    return F.concat(
        _tag("h1", "", title),
        _tag("h2", 'data-testid="articleSubtitle"', "In ", X.html_escape("lang")),
        F.concat(F.lit('<a data-testid="authorName" href="/@'), source, F.lit('">'), source, F.lit("</a>")),
        _tag("time", 'data-testid="articleDate"', F.coalesce(F.date_format(published_at(key), "MMMM d, yyyy"), F.lit("soon"))),
        _tag("span", 'data-testid="readingTime"', (key % 30).cast("string"), " min read"),
        _tag("button", 'data-testid="clapButton"', F.format_number(claps(key) * 10, 0), " claps"),
        _tag("a", 'data-testid="responsesLink" href="/r"', responses(key).cast("string"), " responses"),
        _tag("a", 'data-testid="tagLink" href="/tag/l"', X.html_escape("lang")),
        _tag("a", 'data-testid="tagLink" href="/tag/s"', source),
        F.when(
            key % 4 == 0,
            F.concat(
                _tag("a", 'data-testid="publicationName" href="/pub"', "Pub ", source),
                F.lit('<img data-testid="publicationLogo" src="/logo.png">'),
                _tag("span", 'data-testid="publicationFollowers"', F.format_number(key * 37, 0), " Followers"),
            ),
        ).otherwise(F.lit("")),
        F.when(key % 6 == 0, F.lit('<span data-testid="memberOnlyBadge">member</span>')).otherwise(F.lit("")),
        F.when(
            key % 8 == 0,
            F.concat(
                _tag("a", 'data-testid="seriesName" href="/series"', "Series ", source),
                _tag("b", 'data-testid="seriesPart"', "Part ", (key % 9).cast("string")),
            ),
        ).otherwise(F.lit("")),
    )


def _block(line: Column, i: Column) -> Column:
    text, source, lang = X.html_escape(line), X.html_escape("source"), X.html_escape("lang")
    number = i.cast("string")
    return (
        F.when(i % 6 == 0, _tag("p", "", text))
        .when(i % 6 == 1, _tag("blockquote", "", text, _tag("cite", "", source)))
        .when(i % 6 == 2, F.concat(F.lit('<pre class="hl language-'), lang, F.lit('">'), text, F.lit("</pre>")))
        .when(i % 6 == 3, _tag("h3", "", text))
        .when(i % 6 == 4, _tag("ul", "", _tag("li", "", text), _tag("li", "", lang)))
        .otherwise(
            F.concat(
                F.lit('<img src="/i/'), number, F.lit('.png" alt="'), text, F.lit('" data-caption="'), source,
                F.lit('"><a href="/l/'), number, F.lit('" title="'), lang, F.lit('">'), text, F.lit("</a>"),
            )
        )
    )


def block_pages(documents: DataFrame) -> DataFrame:
    """Every document as an article page; its lines take turns as six kinds of block.

    The blocks stand in two containers of a main element, the first one with a div
    inside, the second one with its attribute in single quotes.
    """
    text_lines = lines("text")
    blocks = F.transform(text_lines, _block)
    half = F.floor(F.size(blocks) / 2).cast("int")
    first = F.array_join(F.slice(blocks, F.lit(1), half), "")
    rest = F.array_join(F.slice(blocks, half + 1, F.size(blocks)), "")
    body = F.concat(
        _tag("div", 'data-testid="articleContent"', _tag("div", "class=inner", first)),
        _tag("div", "data-testid='articleBody'", rest),
    )
    return documents.select(
        F.col("doc_id").alias("page_id"),
        article_url("source", "doc_id").alias("url"),
        F.concat(
            F.lit("<html><head><style>p{}</style></head><body><main><article>"),
            _article_head(F.col("doc_id")), body, F.lit("</article></main></body></html>"),
        ).alias("html"),
    )


def barrier_pages(documents: DataFrame) -> DataFrame:
    """Every document as a page with one of seven barrier marks, or none.

    Marks have attributes in either quotes or none and texts broken by tags; the text
    stands in an article inside another one, inside main.
    """
    marks = (
        "", "<span>Member-<b>only</b> story</span>", "<span data-testid=memberOnlyBadge>x</span>",
        "<div data-testid='subscriptionPrompt'></div>", "<a>Sign in</a>",
        "<div><div>a</div>Create an account</div>", "<div data-testid='x'>This story is for Medium members only</div>",
    )
    return documents.select(
        F.col("doc_id").alias("page_id"),
        article_url("source", "doc_id").alias("url"),
        F.concat(
            _nth(F.col("doc_id"), *marks), F.lit("<main>"),
            _tag("article", "", _tag("article", "", ""), F.coalesce(X.html_escape("text"), F.lit(""))), F.lit("</main>"),
        ).alias("html"),
    )


def run_pages(documents: DataFrame) -> DataFrame:
    """Every document as a whole article page on its source's host, for a run over pages.

    One of seven barrier marks or none, the article's head, its lines as paragraphs, and
    none to four comments.
    """
    marks = (
        "", "<span>Member-<b>only</b> story</span>", "<span data-testid=memberOnlyBadge>x</span>",
        "<div data-testid='subscriptionPrompt'></div>", "<a>Sign in</a>",
        "<div><div>a</div>Create an account</div>", "<div data-testid='x'>This story is for Medium members only</div>",
    )
    key = F.col("doc_id")
    comment = _tag("div", 'data-testid="comment"', _tag("p", 'data-testid="commentContent"', X.html_escape("lang")))
    return documents.select(
        key.alias("page_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"), key.cast("string")).alias("url"),
        F.concat(
            F.lit("<html><body>"), _nth(key, *marks), _article_head(key),
            F.lit("<article>"), _joined(lines("text"), lambda line: _tag("p", "", X.html_escape(line))), F.lit("</article>"),
            F.lit('<section data-testid="responses">'), F.repeat(comment, (key % 5).cast("int")), F.lit("</section></body></html>"),
        ).alias("html"),
    )


def comment_pages(conversations: DataFrame) -> DataFrame:
    """Every turn as a page whose lines are comments; every ninth has no comments section."""
    key = F.col("conv_id") * 1000 + F.col("turn")

    def comment(line: Column, i: Column) -> Column:
        author = F.concat(
            F.lit('<a data-testid="commentAuthor" href="/@'), F.col("role"), F.lit('">'), F.col("role"), F.lit("</a>")
        )
        return _tag(
            "div", 'data-testid="comment"', author,
            _tag("div", 'data-testid="commentContent"', _tag("div", "", X.html_escape(line)), _tag("div", "", "")),
            _tag("span", 'data-testid="commentDate"', (i + 1).cast("string"), " days ago"),
            _tag("span", 'data-testid="commentClaps"', F.format_number((key + i) * 13, 0)),
        )

    section = F.when(key % 9 == 0, F.lit("other")).otherwise(F.lit("responses"))
    return conversations.select(
        key.alias("page_id"),
        F.concat(F.lit(f"{ORIGIN}/p/"), key.cast("string")).alias("url"),
        F.concat(
            F.lit('<section data-testid="'), section, F.lit('">'), _joined(lines("text"), comment), F.lit("</section>")
        ).alias("html"),
    )


def author_pages(documents: DataFrame) -> DataFrame:
    """Every document as an author page that lists its lines as posts."""
    key, source = F.col("doc_id"), X.html_escape("source")

    def post(line: Column, i: Column) -> Column:
        title = F.when(i % 2 == 0, _tag("h2", "", X.html_escape(line))).otherwise(X.html_escape(line))
        return _tag(
            "article", "",
            F.concat(F.lit('<a href="/@'), source, F.lit("/"), i.cast("string"), F.lit('">'), title, F.lit("</a>")),
            _tag("p", "", X.html_escape("lang")),
            _tag("time", "", "Jan ", (i % 28 + 1).cast("string")),
            _tag("span", 'data-testid="readTime"', (i + 1).cast("string"), " min"),
        )

    head = F.concat(
        _tag("h1", 'data-testid="authorName"', " ", source, "  X "),
        _tag("p", 'data-testid="authorBio"', X.html_escape(first_line("text"))),
        _tag("button", 'data-testid="followersCount"', F.format_number(key * 37, 0), " Followers"),
        _tag("a", 'data-testid="followingLink" href="/f"', (key % 500).cast("string"), " Following"),
        F.lit('<img data-testid="authorImage" src="/me.png">'),
        _tag("span", 'data-testid="username"', "@", source),
        F.when(key % 2 == 0, F.lit('<a data-testid="socialLink" aria-label="Site" href="https://s.example.org/">t</a>')).otherwise(
            F.lit('<a rel="noopener" href="/u"> Blog </a>')
        ),
        F.when(
            key % 3 == 0, F.lit('<a data-testid="publicationLink" href="/p1">One <span data-testid="publicationRole">editor</span></a>')
        ).otherwise(F.lit('<a href="/publications/2">Two</a>')),
    )
    return documents.select(
        key.alias("page_id"),
        F.concat(F.lit(f"{ORIGIN}/@"), F.col("source")).alias("url"),
        F.concat(head, _joined(lines("text"), post)).alias("html"),
    )


def _json_text(value: Column) -> Column:
    """JSON that is safe inside a script element."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def state_pages(documents: DataFrame) -> DataFrame:
    """Every document as a page with embedded state; markup is the fallback.

    Paragraph records are stored last line first, while the article lists them in
    reading order.  Every tenth page has broken JSON, every tenth no state at all.
    """
    key, text_lines = F.col("doc_id"), lines("text")
    kinds = ("P", "H3", "BQ", "PRE", "UL", "IMG")
    kind = lambda i: F.get(F.array(*[F.lit(k) for k in kinds]), (i % 6).cast("int"))
    quoted = lambda name: F.concat(F.lit('"'), name, F.lit('":'))
    ref = lambda i: F.concat(F.lit("Paragraph:"), i.cast("string"))
    post = F.struct(
        F.concat(F.lit(" "), first_line("text")).alias("title"),
        F.concat(F.lit("In "), F.col("lang")).alias("subtitle"),
        F.struct(F.concat(F.lit("N "), F.col("source")).alias("name"), F.col("source").alias("username")).alias("creator"),
        F.unix_millis(published_at(key)).alias("firstPublishedAt"),
        ((key % 30) / F.lit(2.0)).alias("readingTime"),
        claps(key).alias("clapCount"),
        responses(key).alias("responseCount"),
        F.array(
            F.struct(F.col("lang").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.col("source").alias("name"))
        ).alias("tags"),
        F.when(key % 4 == 0, F.struct(F.concat(F.lit("C "), F.col("source")).alias("name"), F.lit("c").alias("slug"))).alias("collection"),
        F.when(key % 5 == 0, F.struct(F.lit("pre.png").alias("id"))).alias("previewImage"),
        (key % 6 == 0).alias("isLocked"),
        F.when(key % 7 == 0, F.lit(True)).alias("isMembers"),
        F.when(key % 8 == 0, F.struct(F.lit("Seq").alias("title"), F.lit("sq").alias("slug"))).alias("sequence"),
        F.when(key % 8 == 0, key % 9).alias("sequenceIndex"),
        F.struct(
            F.struct(
                F.transform(text_lines, lambda line, i: F.struct(ref(i).alias("__ref"))).alias("paragraphs")
            ).alias("bodyModel")
        ).alias("content"),
    )

    def paragraph(line: Column, i: Column) -> Column:
        record = F.struct(
            kind(i).alias("type"),
            line.alias("text"),
            F.when((i % 12 == 3), F.struct(F.col("lang").alias("lang"))).alias("codeBlockMetadata"),
            F.when(i % 6 == 5, F.struct(F.lit("Image:1").alias("__ref"))).alias("metadata"),
        )
        return F.concat(quoted(ref(i)), _json_text(record))

    records = F.concat_ws(
        ",",
        F.concat(
            F.lit('"ROOT_QUERY":{"viewer":{"__ref":"User:0"},"post({\\"id\\":1})":{"__ref":"Post:'), key.cast("string"), F.lit('"}}')
        ),
        F.concat(quoted(F.concat(F.lit("Post:"), key.cast("string"))), _json_text(post)),
        F.concat(F.lit('"Image:1":{"id":"im.png","alt":"'), F.col("lang"), F.lit('"}')),
        F.nullif(F.array_join(F.reverse(F.transform(text_lines, paragraph)), ","), F.lit("")),
    )
    opening = F.when(key % 10 == 3, F.lit('{"broken ')).otherwise(F.lit("{"))
    script = F.concat(
        F.lit("<script>var a = 1;</script><script>window.__APOLLO_STATE__ = "), opening, records, F.lit("};</script>")
    )
    return documents.select(
        key.alias("page_id"),
        article_url("source", "doc_id").alias("url"),
        F.concat(
            F.when(key % 10 == 7, F.lit("")).otherwise(script),
            F.lit("<article>"), _article_head(key), F.lit("</article>"),
        ).alias("html"),
    )
