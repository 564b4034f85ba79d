"""The tag pass: nesting, quoting, missing end tags, and time that grows with the markup."""

import time

import pytest

from foliolens.functions import html as H
from foliolens.operators import barrier, markup as M, state as S
from pyspark.sql import functions as F

ARTICLE = (("article", "", "", ""),)


@pytest.fixture(scope="module")
def one(spark):
    def run(column, html):
        return spark.createDataFrame([(html,)], "html string").select(column.alias("out")).first()["out"]

    return run


def test_each_element_ends_at_its_own_end(one):
    found = one(H.elements("html", ARTICLE), "<article>A<article>B</article>C</article><ARTICLE id='x'>D</ARTICLE>")
    assert found == ["<article>A<article>B</article>C</article>", "<article>B</article>", "<ARTICLE id='x'>D</ARTICLE>"]


def test_nested_items_and_unclosed_items(one):
    assert one(H.item_texts("html"), "<ul><li>a<ul><li>b</li></ul> tail</li><li>c</ul>") == ["ab tail", "b", "c"]


@pytest.mark.parametrize("mark", ['"paywall"', "'paywall'", "paywall"])
def test_attribute_values_in_any_quotes(one, mark):
    html = f"<div data-testid={mark}>x<div>y</div>z</div>"
    assert one(H.first_text("html", (("div", "data-testid", "=", "paywall"),)), html) == "xyz"
    assert one(H.has_element("html", (("div", "data-testid", "=", "paywall"),)), html)
    assert one(H.attribute("html", "data-testid"), html) == "paywall"


def test_elements_inside_others(one):
    specs = ((("div", "data-testid", "=", "tags"), ("a", "", "", "")), ("a", "href", "*=", "/tag/"))
    html = "<a href='/tag/x'>0</a><div data-testid='tags'><b><a href=/tag/q>1</a></b><a>2</a></div><a>3</a>"
    assert one(F.transform(H.elements("html", specs), lambda e: H.element_text(e)), html) == ["0", "1", "2"]


def test_character_references(one):
    assert one(H.raw_text("html"), "caf&eacute; it&#8217;s &#x2019; &amp;lt; &bogus; &#0; & x") == "café it’s ’ &lt; &bogus; � & x"


def cues(spark, html):
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    return barrier.barrier_classify(pages).first()


LONG = "word " * 400


@pytest.mark.parametrize("html", [
    f"<main><article>{LONG}</article></main>",
    f"<article><h1>t</h1><div data-testid='articleContent'>{LONG}</div></article>",
    f"<article><article></article>{LONG}</article>",
])
def test_whole_pages_are_not_truncated(spark, html):
    assert not cues(spark, html).has_barrier


def test_text_cues_are_read_through_tags(spark):
    html = f"<span>Member-<b>only</b> story</span><main>{LONG}</main>"
    assert cues(spark, html).indicators == ["premium", "member_only"]


def test_a_comment_keeps_what_follows_a_reply(spark):
    html = (
        '<section data-testid="responses"><div data-testid="comment"><a data-testid="commentAuthor">A</a>'
        '<div data-testid="comment"><a data-testid="commentAuthor">B</a></div>'
        '<span data-testid="commentClaps">7</span></div></section>'
    )
    pages = spark.createDataFrame([(1, "https://e.org/", html)], "page_id bigint, url string, html string")
    assert [(r.author, r.claps) for r in M.comments(pages).orderBy("index").collect()] == [("A", 7), ("B", 0)]


def seconds(spark, column, html):
    frame = spark.createDataFrame([(html,)], "html string").select(column.alias("out"))
    begin = time.perf_counter()
    frame.collect()
    return time.perf_counter() - begin


@pytest.mark.parametrize("build, piece", [
    (lambda: F.size(H.tag_elements("html", "a")), "<a href='x'>t"),
    (lambda: F.length(H.without_code("html")), "x<!-- a "),
    (lambda: F.size(H.elements("html", (("a", "href", "*=", "q"),))), "<a "),
    (lambda: F.size(H.element_groups("html", {"a": (("a", "href", "*=", "x"),)}, every=("a",))["a"]), "<a href='x'>t"),
    (lambda: F.length(S.balanced_object(F.col("html"))), '{"a":'),
])
def test_unclosed_tags_cost_time_in_proportion(spark, build, piece):
    seconds(spark, build(), piece * 1000)
    few, many = seconds(spark, build(), piece * 16_000), seconds(spark, build(), piece * 64_000)
    assert many < 10 * few + 1  # four times the tags; squared growth would be sixteen times


@pytest.mark.parametrize("html, texts", [
    ('<p title="a>b">hello</p>', ["hello"]),
    ("<p>5 <6 and 7> 8</p>", ["5 <6 and 7> 8"]),
    ("<p title='x<b>y' data=\"</p>\">z</p><p>q", ["z", "q"]),
    ('<p a="1>2"><!-- x --><script t="a>b">var a="<p>no</p>"</script>yes</p><p', ["yes"]),
    ("a < b <p>c <", ["c <"]),
    ('<p title="never closed>t</p>', ["t"]),
])
def test_brackets_that_are_no_marks(one, html, texts):
    assert one(H.paragraph_texts(H.without_code("html")), html) == texts


def test_state_ends_at_its_own_brace(one):
    state = "window.__APOLLO_STATE__ = "
    for html, wanted in (
        (f'<script>{state}{{"a":"}}{{\\"","b":{{"c":1}}}}; window.x={{}}</script>', '{"a":"}{\\"","b":{"c":1}}'),
        (f'<script>{state}{{"a":1', None), (f'<script>{state}{{"a":1</script>', None), (f"<script>{state}5</script>", None),
        (f'<p>{state}{{}}</p><script a="x>y">{state}{{"x":{{}}}} </script>', '{"x":{}}'),
    ):
        assert one(S.embedded_state(F.col("html")), html) == wanted


@pytest.mark.parametrize("depth", [1, 15, 16, 17, 18, 60])
def test_objects_of_any_depth_end_at_their_own_brace(one, depth):
    inner = '{"a":' * depth + '"}{"' + "}" * depth
    assert one(S.balanced_object(F.col("html")), inner + ' ; {"b":1}}') == inner
    assert one(S.balanced_object(F.col("html")), inner[:-1]) is None


GROUPS = {
    "title": (("h1", "", "", ""), ("h2", "data-testid", "=", "t")),
    "marked": (("*", "class", "~=", "x"), ("*", "data-testid", "=", "t")),
    "links": (("a", "href", "*=", "/tag/"), ("a", "data-testid", "=", "tag")),
    "image": (("img", "alt", "*=", "post"),),
}


@pytest.mark.parametrize("html", [
    "<h1>a<b class='y x'>b</b></h1><a href=/tag/1>1</a><div><a data-testid='tag'>2</a></div><img alt='a post' src=q>",
    "<div class=x>o<div class='x'>i</div>p</div><h2 data-testid=\"t\">T</h2><H1 ID='q'>late</H1>",
    "<p class='xx'>no</p><img alt='other'><a href='/other/'>z</a>", "", None,
    "<h1>never closed<h1>again</h1><a href='/tag/u'>u<a href='/tag/v'>v</a>",
])
def test_groups_from_one_cut_are_the_elements_of_each(one, html):
    found = one(H.element_groups("html", GROUPS, every=("links", "marked")), html)
    for name, specs in GROUPS.items():
        wanted = one(H.elements("html", specs, only_first=name in ("title", "image")), html)
        assert found[name] == wanted


def test_a_group_element_without_end_ends_at_the_next_of_its_name(one):
    found = one(H.element_groups("html", GROUPS, every=("links",)), "<a href='/tag/1'>1<p class=x>2</p><a>3</a><h1>4")
    assert found["links"] == ["<a href='/tag/1'>1<p class=x>2</p>"] and found["title"] == ["<h1>4"]


def test_groups_take_no_pairs():
    with pytest.raises(ValueError):
        H.element_groups("html", {"pair": ((("p", "", "", ""), ("a", "", "", "")),)})


def test_unclosed_scripts_take_linear_time(one):
    def seconds(count):
        begin = time.perf_counter()
        assert one(S.embedded_state(F.col("html")), "<script>window.__APOLLO_STATE__ = {" * count) is None
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(64_000) < 10
