from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliolens.functions import text as X


def check(evaluate, build, pairs, schema="t string"):
    rows = [given if isinstance(given, tuple) else (given,) for given, _ in pairs]
    assert evaluate(build, rows, schema) == [wanted for _, wanted in pairs]


def test_clean_text(evaluate):
    check(
        evaluate,
        X.clean_text,
        [
            ("  a \t b\n\nc ", "a b c"),
            ("a ​ b", "a  b"),
            (None, ""),
            ("﻿x y‍", "x y"),
        ],
    )


def test_word_count(evaluate):
    check(
        evaluate,
        X.word_count,
        [(None, 0), ("", 0), ("  ", 0), ("a", 1), (" a b ", 2), ("a b\n c", 3), ("a ​ b", 3)],
    )


def test_reading_minutes(evaluate):
    check(
        evaluate,
        X.reading_minutes,
        [
            ("5 min read", 5), ("1 hr 5 min", 60), ("2 hours", 120), ("5 h", 0), (None, 0),
            ("3 Minutes", 3), ("12 HOUR", 720), ("99999999999999999999 min", 0),
        ],
    )


def test_estimate_minutes(evaluate):
    check(
        evaluate,
        X.estimate_minutes,
        [("", 0), ("w", 1), ("w " * 200, 1), ("w " * 201, 2)],
    )


def test_file_slug(evaluate):
    check(
        evaluate,
        X.file_slug,
        [("A: b?/c", "a_bc"), ("...", ""), ("", "untitled"), (None, "untitled"), ("..A\\B \t C.", "ab_c"), ("x" * 300, "x" * 255)],
    )


@pytest.mark.parametrize("text,size,wanted", [("abcdef", 5, "ab..."), ("abcde", 5, "abcde"), ("abcdef", 2, "..."), (None, 3, "")])
def test_truncate(evaluate, text, size, wanted):
    check(evaluate, lambda t: X.truncate(t, size), [(text, wanted)])


def test_marks(evaluate):
    check(evaluate, X.hashtags, [("#A b #A #c-d", ["#a", "#a", "#c"]), (None, [])])
    check(evaluate, X.mentions, [("@Al mail b@c.org", ["@al", "@c"]), ("none", [])])


def test_domain(evaluate):
    check(
        evaluate,
        X.domain,
        [("https://WWW.Ex.com/a", "ex.com"), ("https://my.www.ex.com", "my.ex.com"), ("nope", ""), (None, "")],
    )


def test_valid_url(evaluate):
    check(evaluate, X.is_valid_url, [("https://a.b/c", True), ("nope", False), (None, False)])


def test_summary(evaluate):
    check(evaluate, lambda t: X.summary(t, 2), [("A. B! C? D.", "A.  B!"), (" no end ", "no end"), (None, "")])


def test_counts(evaluate):
    check(evaluate, X.digits_count, [("12,345", 12345), ("1.2K", 12), ("none", 0), (None, 0)])
    check(evaluate, X.suffix_count, [("12,345", 12345), ("1.2K", 1200), ("3M", 3000000), ("2.5k claps", 2500), ("4 Kings", 4), (None, 0)])


def test_contains_either(evaluate):
    check(
        evaluate,
        X.contains_ci_either,
        [(("Data Science", "data"), True), (("ai", "AI Safety"), True), (("x", "y"), False)],
        "a string, b string",
    )


def test_escapes(evaluate):
    check(evaluate, X.html_escape, [("<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"), (None, "")])
    check(evaluate, X.csv_escape, [('say "hi"', 'say ""hi""'), (None, "")])


def test_engagement(evaluate):
    check(evaluate, X.engagement, [((3, 4), 7), ((None, 4), 4)], "a bigint, b bigint")


def test_percent(evaluate):
    check(
        evaluate,
        X.percent,
        [
            ((1, 3), Decimal("33.33")), ((2, 3), Decimal("66.67")), ((1, 800), Decimal("0.13")),
            ((-1, 800), Decimal("-0.13")), ((5, 0), Decimal("0.00")), ((7, 2), Decimal("350.00")),
            ((10**15, 10**15), Decimal("100.00")),
        ],
        "a bigint, b bigint",
    )


def test_keywords(evaluate):
    check(
        evaluate,
        lambda t: X.keywords(t, 2),
        [("b1 bbb aaa bbb the aaa ccc", ["bbb", "aaa"]), ("", []), (None, []), ("of to", []), ("Café x_1 X_1", ["x_1", "caf"])],
    )


def test_keyword_table(evaluate):
    result = evaluate(X.keyword_table, [("zeta alpha, zeta; alpha zeta",)], "t string")[0]
    assert [tuple(k) for k in result] == [("alpha", 2, 1), ("zeta", 3, 0)]


def test_plain_text(spark):
    frame = spark.sql(
        """select named_struct('text_content','body','paragraphs',array('p1'),
             'quotes',array(named_struct('text','q','author','w'), named_struct('text','r','author','')),
             'lists',array(named_struct('type','ol','items',array('a','b')), named_struct('type','ul','items',array('c')))) as content,
           'T' as title, '' as subtitle"""
    )
    text = frame.select(X.plain_text("content", "title", "subtitle").alias("t")).first()["t"]
    assert text == 'T\n\nbody\np1\n"q"\n— w\n\n"r"\n\n1. a\n2. b\n\n• c'


def test_clean_text_is_stable(evaluate):
    rows = [(t,) for t in ["a  b", " x\n\ny ", "é　ß", "​", "tab\tsep"]]
    once = evaluate(X.clean_text, rows, "t string")
    assert evaluate(X.clean_text, [(t,) for t in once], "t string") == once
    assert all("  " not in t for t in once)


def test_truncate_bound(evaluate):
    rows = [("x" * n,) for n in range(12)]
    for size in range(8):
        cut = evaluate(lambda t: X.truncate(t, size), rows, "t string")
        assert all(len(t) <= max(size, 3) for t in cut)
