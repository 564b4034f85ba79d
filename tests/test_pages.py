from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliolens.operators import barrier as B
from foliolens.operators import markup as M
from foliolens.operators import state as S


URL = "https://ex.org/a/b?q=1#f"
def NOW():
    return F.lit("2024-03-31 00:00:00").cast("timestamp")
BODY = f"<article>{'x' * 600}</article>"


def page(spark, *htmls, url=URL):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def plain(value):
    if isinstance(value, list):
        return [plain(v) for v in value]
    return tuple(plain(v) for v in value) if hasattr(value, "asDict") else value


BLOCKS = (
    "<article><h2>H</h2><p> P1 </p><p></p><ul><li>a</li><li>b</li></ul><blockquote>q<cite>w</cite></blockquote>"
    '<pre class="language-py">x=1</pre><img src="s" alt="t" data-caption="c"><a href="/z" title="tt">go</a></article>'
)


def test_content_blocks(spark):
    row = M.page_content(page(spark, BLOCKS)).select("content.*").first()
    assert plain(row["headings"]) == [(2, "H")]
    assert row["paragraphs"] == ["P1"]
    assert plain(row["lists"]) == [("ul", ["a", "b"])]
    assert plain(row["quotes"]) == [("qw", "w")]
    assert plain(row["code_blocks"]) == [("py", "x=1")]
    assert plain(row["images"]) == [("s", "t", "c")]
    assert plain(row["links"]) == [("go", "https://ex.org/z", "tt")]
    assert row["text_content"] == "H P1 a b q w x=1 go"
    assert row["word_count"] == 8


def test_unclosed_paragraphs_code_and_nesting(spark):
    html = (
        '<script>var t="</p><p>no</p>"</script><article><p><b>one<br><p>two &amp; &lt;3</p>'
        "<pre><code>a</code></pre><code class='language-js'>b</code></article><p>outside</p>"
    )
    row = M.page_content(page(spark, html)).select("content.*").first()
    assert row["paragraphs"] == ["one", "two & <3"]
    assert plain(row["code_blocks"]) == [("unknown", "a"), ("unknown", "a"), ("js", "b")]


def test_containers_balance_nested_tags(spark):
    html = (
        '<article><div data-testid="articleContent"><p>a</p><div><p>b</p></div><p>c</p></div><p>footer</p></article>'
        '<div data-testid="articleBody"><p>d</p></div>'
    )
    row = M.markup_content(page(spark, html)).first()
    assert [c["paragraphs"] for c in row["contents"]] == [["a", "b", "c"], ["d"]]
    flat = M.page_content(page(spark, html)).first()["content"]
    assert flat["paragraphs"] == ["a", "b", "c", "d"]
    assert (flat["text_content"], flat["word_count"]) == ("a b c d", 4)


MARKUP_ARTICLE = (
    '<article><h1> A  title </h1><h2 data-testid="articleSubtitle">Sub</h2>'
    '<a data-testid="authorName" href="/@n">N &amp; M</a><time data-testid="articleDate">March 19, 2024</time>'
    '<span data-testid="readingTime">5 min read</span><button data-testid="clapButton">1,234</button>'
    '<a data-testid="responsesLink" href="/r">12 responses</a><a data-testid="tagLink" href="/tag/x">x</a>'
    '<a href="/tag/y"> </a><a data-testid="publicationName" href="/pub">Pub</a>'
    '<img data-testid="articleImage" src="/i.png"><span data-testid="memberOnlyBadge">m</span>'
    '<a data-testid="seriesName" href="/s">S</a><b data-testid="seriesPart">Part 2</b></article>'
)


def test_markup_article(spark):
    a = M.markup_article(page(spark, MARKUP_ARTICLE), NOW()).first()["article"].asDict(recursive=True)
    assert a == {
        "title": "A title", "subtitle": "Sub", "author": "N & M", "author_url": "https://ex.org/@n",
        "published_at": datetime(2024, 3, 19), "read_time": 5.0, "claps": 1234, "responses": 12,
        "tags": ["x"], "publication": {"name": "Pub", "url": "https://ex.org/pub"},
        "main_image": "https://ex.org/i.png", "is_premium": True, "url": URL,
        "series": {"name": "S", "url": "https://ex.org/s", "part": "Part 2"},
    }


def test_markup_article_defaults(spark):
    a = M.markup_article(page(spark, "<p>nothing</p>"), NOW()).first()["article"]
    assert (a["title"], a["published_at"], a["claps"], a["tags"], a["series"], a["is_premium"]) == ("", None, 0, [], None, False)


STATE = """{"ROOT_QUERY": {"post(1)": {"__ref": "Post:1"}},
 "Post:1": {"title": " T ", "creator": {"name": "N", "username": "u"},
            "firstPublishedAt": 1710849600000, "readingTime": 4.2,
            "clapCount": 7, "responseCount": 2,
            "tags": [{"name": "x"}, {"name": ""}], "isLocked": true,
            "collection": {"name": "C", "slug": "c"},
            "content": {"bodyModel": {"paragraphs": [{"__ref": "Paragraph:b"}, {"__ref": "Paragraph:a"}]}}},
 "Paragraph:a": {"type": "P", "text": "second"},
 "Paragraph:b": {"type": "H3", "text": "first"},
 "Paragraph:c": {"type": "IMG", "metadata": {"__ref": "Image:1"}},
 "Paragraph:d": {"type": "UL", "text": "i\\nj\\n"},
 "Paragraph:e": {"type": "PRE", "text": "code"},
 "Image:1": {"id": "img.png", "alt": "al"}}"""
STATE_PAGE = f"<html><script>a=1</script><script>window.__APOLLO_STATE__ = {STATE};</script>{MARKUP_ARTICLE}</html>"


def test_state_article_and_fallbacks(spark):
    broken = STATE_PAGE.replace('{"ROOT_QUERY"', '{"ROOT_QUERY')
    rows = S.article_info(page(spark, STATE_PAGE, MARKUP_ARTICLE, broken), NOW()).orderBy("page_id").collect()
    first = rows[0]["article"]
    assert (first["title"], first["author"], first["author_url"]) == ("T", "N", "https://medium.com/@u")
    assert first["published_at"] == datetime(2024, 3, 19, 12)
    assert (first["read_time"], first["claps"], first["responses"], first["tags"], first["is_premium"]) == (4.2, 7, 2, ["x"], True)
    assert plain(first["publication"]) == ("C", "https://medium.com/c")
    assert first["url"] == URL
    assert [r["article"]["title"] for r in rows[1:]] == ["A title", "A title"]


def test_state_blocks_and_content(spark):
    blocks = S.state_blocks(page(spark, STATE_PAGE)).first()["blocks"]
    assert [(b["type"], b["text"]) for b in blocks] == [
        ("heading", "first"), ("paragraph", "second"), ("image", ""), ("list", ""), ("code", ""),
    ]
    content = S.state_content(page(spark, STATE_PAGE)).first()["content"]
    assert content["text_content"] == "first second"
    assert plain(content["images"]) == [("https://miro.medium.com/img.png", "al", "")]
    assert plain(content["lists"]) == [("ul", ["i", "j"])]
    assert plain(content["code_blocks"]) == [("unknown", "code")]
    assert plain(content["headings"]) == [(3, "first")]


def test_state_deref(spark):
    rows = S.state_deref(page(spark, STATE_PAGE)).select("from_key", "position", "key").collect()
    assert sorted(map(tuple, rows)) == [
        ("Paragraph:c", 0, "Image:1"), ("Post:1", 0, "Paragraph:b"), ("Post:1", 1, "Paragraph:a"), ("ROOT_QUERY", 0, "Post:1"),
    ]


def test_assemble_flags(spark):
    names = S.assemble_article(page(spark, STATE_PAGE), NOW(), include_content=False, include_comments=True).columns
    assert names == ["page_id", "article", "comments", "publication"]


def test_comments(spark):
    html = (
        '<section data-testid="responses"><div data-testid="comment"><a data-testid="commentAuthor" href="/@z">Z</a>'
        '<div data-testid="commentContent"><div>deep</div> text</div><span data-testid="commentDate">2 days ago</span>'
        '<span data-testid="commentClaps">1,0 claps</span></div><div data-testid="comment"></div></section>'
    )
    outside = html.replace("responses", "other")
    rows = M.comments(page(spark, html, outside)).orderBy("index").collect()
    assert [tuple(r) for r in rows] == [
        (0, URL, "Z", "https://ex.org/@z", "deep text", "2 days ago", 10, 0), (0, URL, "", "", "", "", 0, 1),
    ]


def test_publication(spark):
    html = (
        '<a data-testid="publicationName" href="/p">P</a><img data-testid="publicationLogo" src="/l.png">'
        '<p data-testid="publicationDescription">about</p><span data-testid="publicationFollowers">1,200 Followers</span>'
    )
    rows = M.publication(page(spark, html, "<p>none</p>")).orderBy("page_id").collect()
    assert plain(rows[0]["publication"]) == ("P", "https://ex.org/p", "https://ex.org/l.png", "about", 1200)
    assert rows[1]["publication"] is None


def test_author(spark):
    html = (
        '<h1 data-testid="authorName"> Ann  B </h1><p data-testid="authorBio">bio</p><a href="/x/followers">1.2K Followers</a>'
        '<a data-testid="followingLink">34</a><img alt="my profile" src="/me.png"><span data-testid="username">@ann</span>'
        '<a data-testid="socialLink" aria-label="Site" href="https://s.org">t</a><a rel="noopener" href="/u"> Blog </a><a rel="noopener" href="/v"></a>'
        '<a data-testid="publicationLink" href="/p1">One<span data-testid="publicationRole">editor</span></a><a href="/publications/2">Two</a>'
    )
    row = M.author_profile(page(spark, html)).first()
    assert tuple(row) == (0, "Ann B", "bio", 12, 34, "https://ex.org/me.png", "@ann", URL)
    links = M.author_links(page(spark, html)).first()
    assert plain(links["social_links"]) == [("Site", "https://s.org"), ("Blog", "https://ex.org/u"), ("unknown", "https://ex.org/v")]
    assert plain(links["publications"]) == [("Oneeditor", "https://ex.org/p1", "editor"), ("Two", "https://ex.org/publications/2", "writer")]
    assert M.author_profile(page(spark, None)).first()["name"] == "Unknown"


def test_listing_steps(spark):
    direct = (
        '<article><a href="/@u/one"><h2>One</h2></a><p>Sub one</p><time>Jan 1</time><span data-testid="readingTime">5 min</span></article>'
        '<article><div>Sub two</div><a href="https://o.org/@u/two">Two</a><a href="/@u/none"></a></article><a data-testid="postLink" href="/three">Three</a>'
    )
    second = '<article><a href="/plain">Plain</a></article>'
    boxes = '<div data-testid="postCard"><div><a href="/boxed">Boxed</a></div></div>'
    rows = M.listing(page(spark, direct, second, boxes, "<a href='/x'>x</a>")).orderBy("page_id", "index").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, "One", "Sub one", "https://ex.org/@u/one", "Jan 1", "5 min"),
        (0, 1, "Two", "Sub two", "https://o.org/@u/two", "", ""),
        (0, 3, "Three", "", "https://ex.org/three", "", ""),
        (1, 0, "Plain", "", "https://ex.org/plain", "", ""),
        (2, 0, "Boxed", "", "https://ex.org/boxed", "", ""),
    ]


def test_body_text_cascade(spark):
    long = "y" * 30
    rows = M.body_text_cascade(
        page(
            spark,
            f"<article><p>short</p><p>{long}</p><p>{long}</p></article>",
            f"<main><h1>{long}</h1><h1>{long}</h1></main>",
            "<article><p>tiny</p></article>",
        )
    ).orderBy("page_id").collect()
    assert [r["body_text"] for r in rows] == [f"{long}\n\n{long}", f"{long}\n\n{long}", None]


def test_census(spark):
    html = '<title>T</title><article data-testid="postX"><h2>a</h2><h3>b</h3><a href="/@u">' + "z" * 60 + "</a></article>"
    row = M.page_census(page(spark, html)).first()
    assert tuple(row)[1:10] == ("T", URL, 1, 1, 1, 1, 1, 1, 1)
    assert plain(row["first_links"]) == [("https://ex.org/@u", "z" * 50)]


@pytest.mark.parametrize(
    "html,wanted,compat",
    [
        (BODY, (None, 0, 0.0), (None, 0, 0.0)),
        ("<span>Member-only story</span>" + BODY, ("premium", 2, 0.5), ("unknown", 1, 0.25)),
        ('<span data-testid="memberOnlyBadge">x</span>' + BODY, ("premium", 2, 0.5), ("premium", 2, 0.5)),
        ('<div data-testid="subscriptionPrompt">' + BODY, ("subscription_prompt", 1, 0.25), ("subscription_prompt", 1, 0.25)),
        ("<a>Sign in</a>" + BODY, ("login_required", 1, 0.25), (None, 0, 0.0)),
        ("<div><div>a</div>Continue reading</div>" + BODY, ("subscription_prompt", 1, 0.25), (None, 0, 0.0)),
        ('<img alt="Sign in">Sign in' + BODY, (None, 0, 0.0), (None, 0, 0.0)),
        (f"<article>{'x' * 499}</article>", ("content_truncation", 1, 0.25), ("content_truncation", 1, 0.25)),
        (f"<article>{'x' * 500}</article>", (None, 0, 0.0), (None, 0, 0.0)),
        ("<p>none</p>", ("content_truncation", 1, 0.25), ("content_truncation", 1, 0.25)),
    ],
)
def test_barriers(spark, html, wanted, compat):
    for flag, expected in ((False, wanted), (True, compat)):
        row = B.barrier_classify(page(spark, html), compat=flag).first()
        assert (row["barrier_type"], len(row["indicators"]), row["confidence"]) == expected
        assert row["has_barrier"] == (expected[0] is not None)
