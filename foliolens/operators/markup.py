"""Pages to relations: articles, content, comments, authors and listings from markup.

Operators take a pages relation ``(page_id, url, html)`` and return a DataFrame
without ``html``.  Everything happens inside the page's own row, so no operator
here shuffles.  Visibility cannot be known from stored markup; presence counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens import schemas
from foliolens.functions import dates, html as H, text as X
from foliolens.functions.tags import found_in, found_in_each

ARTICLE_TAG = (("article", "", "", ""),)
MAIN_TAG = (("main", "", "", ""),)


# --- content blocks -------------------------------------------------------------


def headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])(?:\s[^>]*)?>.*?</h\1\s*>"), F.lit(0))
    return F.transform(
        found,
        lambda h: F.struct(
            F.substring(h, 3, 1).cast("int").alias("level"), H.element_text(h).alias("text")
        ),
    )


# What is looked for in a container: lists with their items, quotes with their authors, and the rest.
_CONTENT_CUTS = {
    "lists": H.cut_for((("ul", "", "", ""), ("ol", "", "", "")), inner=H.cut_for((("li", "", "", ""),))),
    "quotes": H.cut_for((("blockquote", "", "", ""),), inner=H.cut_for((("cite", "", "", ""),), only_first=True)),
    "code_blocks": H.cut_for((("pre", "", "", ""), ("code", "", "", ""))),
    "images": H.cut_for((("img", "", "", ""),)),
    "links": H.cut_for((("a", "href", "*=", ""),)),
}


def _with_inner(elements: Column, find) -> Column:
    return F.transform(elements, lambda own: F.struct(own.alias("own"), find(own).alias("inner")))


def lists(html: Column) -> Column:
    found = H.elements(html, (("ul", "", "", ""), ("ol", "", "", "")))
    return lists_of(_with_inner(found, lambda lst: H.tag_elements(lst, "li")))


def lists_of(found: Column) -> Column:
    return F.transform(
        found,
        lambda lst: F.struct(
            F.lower(F.substring(lst["own"], 2, 2)).alias("type"), H.texts_of_items(lst["inner"]).alias("items")
        ),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, position, depth, list_type, item)`` for every list item of every page, lists in lists too."""
    found = pages.select("page_id", H.list_items(H.without_code("html")).alias("found"))
    return X.exploded(found, ["page_id"], F.col("found"), "position", "one").select("page_id", "position", "one.*")


def quotes(html: Column) -> Column:
    found = H.tag_elements(html, "blockquote")
    return quotes_of(_with_inner(found, lambda quote: H.elements(quote, (("cite", "", "", ""),), only_first=True)))


def quotes_of(found: Column) -> Column:
    return F.transform(
        found,
        lambda q: F.struct(
            H.element_text(q["own"]).alias("text"),
            H.element_text(H.first_of(q["inner"])).alias("author"),
        ),
    )


def code_blocks(html: Column) -> Column:
    """``pre`` and ``code`` elements in page order; code inside pre is listed too."""
    return code_blocks_of(H.elements(html, (("pre", "", "", ""), ("code", "", "", ""))))


def code_blocks_of(found: Column) -> Column:
    def described(block: Column) -> Column:
        language = F.regexp_extract(H.attribute(block, "class"), "language-([0-9A-Za-z_]+)", 1)
        return F.struct(
            F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown")).alias("language"),
            H.element_text(block).alias("code"),
        )

    return F.transform(found, described)


def images(html: Column) -> Column:
    return images_of(H.tag_elements(html, "img"))


def images_of(found: Column) -> Column:
    return F.transform(
        found,
        lambda img: F.struct(
            H.attribute(img, "src").alias("src"),
            H.attribute(img, "alt").alias("alt"),
            H.attribute(img, "data-caption").alias("caption"),
        ),
    )


def links(html: Column, page_url: Column) -> Column:
    return links_of(H.elements(html, (("a", "href", "*=", ""),)), page_url)


def links_of(found: Column, page_url: Column) -> Column:
    return F.transform(
        found,
        lambda a: F.struct(
            H.element_text(a).alias("text"),
            H.absolute_url(H.attribute(a, "href"), page_url).alias("url"),
            H.attribute(a, "title").alias("title"),
        ),
    )


def content_structs(boxes: Column, page_url: Column) -> Column:
    """All blocks of every container of a page."""
    return F.zip_with(
        boxes, found_in_each(boxes, _CONTENT_CUTS), lambda box, found: content_struct(box, found, page_url)
    )


def content_struct(container: Column, found: Column, page_url: Column) -> Column:
    """All blocks of one container, its readable text and word count."""
    return X.bind(
        H.element_text(container, " "),
        lambda text: F.struct(
            text.alias("text_content"),
            headings(container).alias("headings"),
            H.paragraph_texts(container).alias("paragraphs"),
            lists_of(found["lists"]).alias("lists"),
            quotes_of(found["quotes"]).alias("quotes"),
            code_blocks_of(found["code_blocks"]).alias("code_blocks"),
            images_of(found["images"]).alias("images"),
            links_of(found["links"], page_url).alias("links"),
            X.word_count(text).alias("word_count"),
        ),
    )


CONTAINER_CUTS = {"marked": H.cut_for(V.CONTENT_CONTAINER), "articles": H.cut_for(ARTICLE_TAG)}


def content_containers(html: Column, told: Column | None = None) -> Column:
    """The marked content containers; without any, the page's articles.

    ``told`` is what ``CONTAINER_CUTS`` found where that has been looked for already.
    """
    return X.bind(
        found_in(html, CONTAINER_CUTS) if told is None else told,
        lambda found: F.when(F.size(found["marked"]) > 0, found["marked"]).otherwise(found["articles"]),
    )


def flatten_content(contents: Column) -> Column:
    """Merge the content structs of one page; words are recounted on the cleaned text."""

    def merged(field: str) -> Column:
        return F.flatten(F.transform(contents, lambda c: c[field])).alias(field)

    joined = F.array_join(F.transform(contents, lambda c: X.text_or_empty(c["text_content"])), " ")
    return X.bind(
        X.clean_text(joined),
        lambda text: F.struct(
            text.alias("text_content"),
            *[
                merged(field)
                for field in (
                    "headings", "paragraphs", "lists", "quotes", "code_blocks", "images", "links",
                )
            ],
            X.cleaned_word_count(text).alias("word_count"),
        ),
    )


def markup_content(pages: DataFrame) -> DataFrame:
    """``(page_id, url, contents)``: one content struct per container, in page order."""
    found = pages.select("page_id", "url", content_containers(H.without_code("html")).alias("found"))
    return found.select(
        "page_id", "url",
        content_structs(F.col("found"), F.col("url")).alias("contents"),
    )


def page_content(pages: DataFrame) -> DataFrame:
    """``(page_id, url, content)`` with the containers merged."""
    return markup_content(pages).select("page_id", "url", flatten_content(F.col("contents")).alias("content"))


def page_words(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, word_count)``: only the clean readable text of each page."""
    texts = pages.select(
        "page_id", "url",
        X.clean_text(
            F.array_join(
                F.transform(
                    content_containers(H.without_code("html")), lambda c: H.element_text(c, " ")
                ),
                " ",
            )
        ).alias("text"),
    )
    return texts.withColumn("word_count", X.cleaned_word_count("text"))


# --- article fields ---------------------------------------------------------------


def article_struct(html: Column, page_url: Column, now: Column, told: Column | None = None) -> Column:
    """Article fields from markup: the first match of each field.  ``told`` is what ``ARTICLE_CUT`` found."""
    found = found_in(html, {"found": ARTICLE_CUT})["found"] if told is None else told
    return X.bind(found, lambda found: _article_of(found, html, page_url, now))


_ARTICLE_FIELDS = {
    "title": V.TITLE, "subtitle": V.SUBTITLE, "byline": V.BYLINE, "date": V.DATE, "read_time": V.READ_TIME,
    "claps": V.CLAPS, "responses": V.RESPONSES, "tags": V.TAG_LINKS, "publication": V.PUBLICATION,
    "main_image": V.MAIN_IMAGE, "series": V.SERIES_NAME, "part": V.SERIES_PART,
}
ARTICLE_CUT = H.cut_for_groups(_ARTICLE_FIELDS, every=("tags",))


def _article_of(found: Column, html: Column, page_url: Column, now: Column) -> Column:
    byline, publication, series = (H.first_of(found[name]) for name in ("byline", "publication", "series"))

    def text(name: str) -> Column:
        return H.element_text(H.first_of(found[name]))

    def link(element: Column) -> Column:
        return linked(element, "href", page_url)

    tag_texts = F.transform(found["tags"], lambda tag: H.element_text(tag))
    series_name = H.element_text(series)
    return F.struct(
        X.clean_text(text("title")).alias("title"),
        X.clean_text(text("subtitle")).alias("subtitle"),
        X.clean_text(H.element_text(byline)).alias("author"),
        link(byline).alias("author_url"),
        dates.parse_article_date(text("date"), now).alias("published_at"),
        X.reading_minutes(text("read_time")).cast("double").alias("read_time"),
        X.digits_count(text("claps")).alias("claps"),
        X.digits_count(text("responses")).alias("responses"),
        F.filter(tag_texts, lambda tag: tag != "").alias("tags"),
        F.struct(
            H.element_text(publication).alias("name"), link(publication).alias("url")
        ).alias("publication"),
        link_of_image(H.first_of(found["main_image"]), page_url).alias("main_image"),
        H.has_element(html, V.PREMIUM_FLAG).alias("is_premium"),
        page_url.alias("url"),
        F.when(
            series_name != "",
            F.struct(series_name.alias("name"), link(series).alias("url"), text("part").alias("part")),
        ).alias("series"),
    ).cast(schemas.ARTICLE)


def linked(element: Column, name: str, page_url: Column) -> Column:
    """The URL in an attribute of an element; '' if it has none."""
    return X.bind(
        H.attribute(element, name), lambda link: F.when(link == "", F.lit("")).otherwise(H.absolute_url(link, page_url))
    )


def link_of_image(element: Column, page_url: Column) -> Column:
    return linked(element, "src", page_url)


def markup_article(pages: DataFrame, now: Column) -> DataFrame:
    cleaned = pages.select("page_id", "url", H.without_code("html").alias("markup"))
    return cleaned.select("page_id", article_struct(F.col("markup"), F.col("url"), now).alias("article"))


# --- comments, publication, author ---------------------------------------------------


_COMMENT_FIELDS = {
    "author": V.COMMENT_AUTHOR, "content": V.COMMENT_CONTENT, "date": V.COMMENT_DATE, "claps": V.COMMENT_CLAPS,
}
COMMENT_CUT = H.cut_for(V.COMMENT, inner=H.cut_for_groups(_COMMENT_FIELDS))


def has_comments(html: Column) -> Column:
    return H.has_element(html, V.COMMENTS_SECTION)


def comment_structs(html: Column, page_url: Column, told: Column | None = None) -> Column:
    """Comments of a page in page order; empty without a comments section.

    ``told`` is what ``COMMENT_CUT`` found in a page with such a section.
    """

    def one_comment(comment: Column, index: Column) -> Column:
        author, content, date, claps = (H.first_of(comment["inner"][name]) for name in _COMMENT_FIELDS)
        return F.struct(
            H.element_text(author).alias("author"),
            linked(author, "href", page_url).alias("author_url"),
            H.element_text(content).alias("content"),
            H.element_text(date).alias("date"),
            X.digits_count(H.element_text(claps)).alias("claps"),
            index.cast("bigint").alias("index"),
        )

    nothing = F.array().cast(
        "array<struct<author:string,author_url:string,content:string,date:string,claps:bigint,index:bigint>>"
    )
    has_section = has_comments(html)
    found = found_in(F.when(has_section, html), {"found": COMMENT_CUT})["found"] if told is None else told
    return F.when(has_section, F.transform(found, one_comment)).otherwise(nothing)


def comments(pages: DataFrame) -> DataFrame:
    """Child table: one row per comment, keyed by page and position."""
    found = pages.select(
        "page_id", "url", comment_structs(H.without_code("html"), F.col("url")).alias("found")
    )
    placed = X.exploded(found, ["page_id", "url"], F.col("found"), "position", "c")
    return placed.select("page_id", "url", "c.*")


_PUBLICATION_FIELDS = {
    "element": V.PUBLICATION, "logo": V.PUBLICATION_LOGO, "description": V.PUBLICATION_DESCRIPTION,
    "followers": V.PUBLICATION_FOLLOWERS,
}
PUBLICATION_CUT = H.cut_for_groups(_PUBLICATION_FIELDS)


def publication_struct(html: Column, page_url: Column, told: Column | None = None) -> Column:
    """The publication a page names; null without one.  ``told`` is what ``PUBLICATION_CUT`` found."""
    def described(found: Column) -> Column:
        element, logo, description, followers = (H.first_of(found[name]) for name in _PUBLICATION_FIELDS)
        return F.when(
            element != "",
            F.struct(
                H.element_text(element).alias("name"),
                linked(element, "href", page_url).alias("url"),
                link_of_image(logo, page_url).alias("logo"),
                H.element_text(description).alias("description"),
                X.digits_count(H.element_text(followers)).alias("followers"),
            ),
        )

    return X.bind(found_in(html, {"found": PUBLICATION_CUT})["found"] if told is None else told, described)


def publication(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", publication_struct(H.without_code("html"), F.col("url")).alias("publication")
    )


def author_profile(pages: DataFrame) -> DataFrame:
    """Author fields of an author page; a page without markup gives the default row."""
    fields = {
        "name": V.AUTHOR_NAME, "bio": V.AUTHOR_BIO, "followers": V.AUTHOR_FOLLOWERS, "following": V.AUTHOR_FOLLOWING,
        "avatar": V.AUTHOR_AVATAR, "username": V.AUTHOR_USERNAME,
    }

    def described(found: Column) -> Column:
        name, bio, followers, following, avatar, username = (H.first_of(found[field]) for field in fields)
        return F.struct(
            F.when(F.col("html").isNull(), F.lit("Unknown")).otherwise(X.clean_text(H.element_text(name))).alias("name"),
            X.clean_text(H.element_text(bio)).alias("bio"),
            X.digits_count(H.element_text(followers)).alias("followers"),
            X.digits_count(H.element_text(following)).alias("following"),
            link_of_image(avatar, F.col("url")).alias("avatar"),
            H.element_text(username).alias("username"),
        )

    cleaned = pages.select("page_id", "url", "html", H.without_code("html").alias("markup"))
    told = cleaned.select(
        "page_id", "url", X.bind(H.element_groups(F.col("markup"), fields), described).alias("profile")
    )
    return told.select("page_id", "profile.*", "url")


def author_links(pages: DataFrame) -> DataFrame:
    """``(page_id, social_links, publications)`` of author pages."""
    markup, url = F.col("markup"), F.col("url")

    def or_default(value: Column, default: str | Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default) if isinstance(default, str) else default)

    def social(a: Column) -> Column:
        label = or_default(H.attribute(a, "aria-label"), F.nullif(H.element_text(a), F.lit("")))
        return F.struct(
            F.coalesce(label, F.lit("unknown")).alias("platform"),
            H.absolute_url(H.attribute(a, "href"), url).alias("url"),
        )

    def listed(a: Column) -> Column:
        return F.struct(
            H.element_text(a).alias("name"),
            H.absolute_url(H.attribute(a, "href"), url).alias("url"),
            or_default(H.first_text(a, V.PUBLICATION_ROLE), "writer").alias("role"),
        )

    return pages.select("page_id", "url", H.without_code("html").alias("markup")).select(
        "page_id",
        F.transform(H.elements(markup, V.SOCIAL_LINKS), social).alias("social_links"),
        F.transform(H.elements(markup, V.AUTHOR_PUBLICATIONS), listed).alias("publications"),
    )


# --- listings ---------------------------------------------------------------------


def listing(pages: DataFrame) -> DataFrame:
    """Posts listed on author pages: one row per post with its position on the page.

    Four ways of finding post links are tried; the first that finds any is used.
    """
    url = F.col("url")
    no_links = F.array().cast("array<struct<anchor:string,context:string>>")

    def in_context(anchors: Column, context: Column) -> Column:
        return F.transform(anchors, lambda a: F.struct(a.alias("anchor"), context.alias("context")))

    def within(name: str) -> Column:
        return F.flatten(F.zip_with(
            "articles", "found", lambda box, found: in_context(found[name], box)
        ))

    def direct_links(anchors: Column) -> Column:
        return in_context(F.filter(anchors, lambda a: ~F.contains(H.attribute(a, "href"), F.lit("/@"))), F.lit(""))

    markup, told = F.col("markup"), F.col("told")
    anchor_cut = H.cut_for((("a", "", "", ""),))
    cleaned = pages.select("page_id", "url", H.without_code("html").alias("markup"))
    boxed = cleaned.select("page_id", "url", found_in(markup, {
        "articles": H.cut_for(ARTICLE_TAG), "boxes": H.cut_for(V.POST_LINK_BOXES, inner=anchor_cut),
        "anywhere": H.cut_for(V.POST_LINKS_ANYWHERE), "marked": H.cut_for(V.POST_BOXES, inner=anchor_cut),
    }).alias("told"))
    # Ways that find links inside of articles look at each article once.
    looked = boxed.select("page_id", "url", "told", told["articles"].alias("articles"), found_in_each(told["articles"], {
        "direct": H.cut_for(V.POST_LINKS_IN_ARTICLE), "anchors": anchor_cut,
        "headings": H.cut_for((("h2", "", "", ""), ("h3", "", "", "")), inner=anchor_cut),
    }).alias("found"))

    def inner_of(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda one: one["inner"]))

    direct = F.concat(
        within("direct"), F.flatten(F.transform(told["boxes"], lambda box: direct_links(box["inner"]))),
        direct_links(told["anywhere"]),
    )
    in_headings = F.flatten(F.zip_with(
        "articles", "found", lambda box, found: in_context(inner_of(found["headings"]), box)
    ))
    in_boxes = in_context(inner_of(told["marked"]), F.lit(""))
    steps = (direct, within("anchors"), in_headings, in_boxes)
    chosen = F.coalesce(*[X.bind(step, lambda found: F.when(F.size(found) > 0, found)) for step in steps], no_links)

    titles = [f"title{i}" for i in range(len(V.POST_TITLE_STEPS))]

    def title_of(anchor: Column, found: Column) -> Column:
        titled = F.coalesce(*[F.get(found[name], 0) for name in titles], F.lit(""))
        return X.bind(H.element_text(titled), lambda text: F.when(text != "", text).otherwise(H.element_text(anchor)))

    def context_text(context: Column) -> Column:
        paragraph = F.regexp_extract(
            context, rf"(?is)<(p(?=[\s>])|div(?![^>]*data-testid))[^>]*>.*?(?=</?(?:p|div|article|h[1-6]|ul|ol)[\s>]|$)", 0
        )
        return H.element_text(paragraph)

    placed = X.exploded(looked, ["page_id", "url"], chosen, "index", "post")
    anchor, context = F.col("post.anchor"), F.col("post.context")
    in_anchor = found_in(anchor, {
        name: H.cut_for(specs, only_first=True) for name, specs in zip(titles, V.POST_TITLE_STEPS)
    })
    in_post = found_in(context, {
        "date": H.cut_for(V.POST_DATE, only_first=True), "read_time": H.cut_for(V.POST_READ_TIME, only_first=True),
    })
    read = placed.select("*", in_anchor.alias("in_anchor"), in_post.alias("in_post"))
    named = X.computed(read, title=title_of(anchor, F.col("in_anchor")), href=H.attribute(anchor, "href"))
    return named.filter((F.length("title") > 0) & (F.length("href") > 0)).select(
        "page_id",
        "index",
        "title",
        context_text(context).alias("subtitle"),
        H.absolute_url("href", url).alias("url"),
        H.element_text(H.first_of(F.col("in_post.date"))).alias("date"),
        H.element_text(H.first_of(F.col("in_post.read_time"))).alias("read_time"),
    )


def require_title_url(rows: DataFrame) -> DataFrame:
    return rows.filter((F.length("title") > 0) & (F.length("url") > 0))


def page_census(pages: DataFrame) -> DataFrame:
    """Counts per kind of element, the page title, and the first ten links."""
    cleaned = pages.select(
        "page_id", "url", H.without_code("html").alias("markup"),
    )
    markup = F.col("markup")

    def counted(pattern: str, name: str) -> Column:
        return F.regexp_count(markup, F.lit(pattern)).cast("bigint").alias(name)

    first_links = F.transform(
        F.slice(H.tag_elements(markup, "a"), 1, 10),
        lambda a: F.struct(
            F.when(H.attribute(a, "href") == "", F.lit(""))
            .otherwise(H.absolute_url(H.attribute(a, "href"), F.col("url")))
            .alias("href"),
            F.substring(H.element_text(a), 1, 50).alias("text"),
        ),
    )
    return cleaned.select(
        "page_id",
        H.first_text(markup, (("title", "", "", ""),)).alias("title"),
        "url",
        counted(r"(?i)<article[\s>]", "article_count"),
        counted(r'(?i)<a\s[^>]*href="[^"]*/@', "author_link_count"),
        counted(r'(?i)<[a-z][^>]*\sdata-testid="[^"]*(?:post|article)', "post_count"),
        counted(r"(?i)<h2[\s>]", "h2_count"),
        counted(r"(?i)<h3[\s>]", "h3_count"),
        counted(r"(?i)<[a-z][^>]*\sdata-testid[=\s>]", "testid_count"),
        counted(r"(?i)<a[\s>]", "link_count"),
        first_links.alias("first_links"),
    )


def body_text_cascade(pages: DataFrame) -> DataFrame:
    """Plain text from the first kind of element that a page has; null when too short."""
    regions = {
        "article": ARTICLE_TAG,
        "main": MAIN_TAG,
        "articleContent": (("*", "data-testid", "=", "articleContent"),),
        "articleBody": (("*", "data-testid", "=", "articleBody"),),
    }
    cleaned = pages.select("page_id", H.without_code("html").alias("markup"))
    boxed = cleaned.select(
        "page_id",
        *[H.containers("markup", specs).alias(name) for name, specs in regions.items()],
    )

    def texts(region: str, tag: str) -> Column:
        if tag == "p":
            return F.flatten(F.transform(F.col(region), H.all_paragraph_texts))
        return F.flatten(
            F.transform(
                F.col(region),
                lambda box: F.transform(H.tag_elements(box, tag), lambda e: H.element_text(e)),
            )
        )

    found = F.coalesce(
        *[
            X.bind(texts(region, tag), lambda t: F.when(F.size(t) > 0, t))
            for region, tag in V.BODY_TEXT_STEPS
        ]
    )
    kept = F.filter(F.col("found"), lambda text: F.length(text) > V.CASCADE_MIN_PART)
    joined = boxed.select("page_id", found.alias("found")).select(
        "page_id", F.array_join(kept, "\n\n").alias("joined")
    )
    return joined.select(
        "page_id", F.when(F.length("joined") > V.CASCADE_MIN_TOTAL, F.col("joined")).alias("body_text")
    )
