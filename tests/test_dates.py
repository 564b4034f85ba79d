from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliolens.functions import dates as D

NOW = datetime(2024, 3, 31)


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("January 1, 2024", datetime(2024, 1, 1)),
        ("posted sept 5, 2023 by x", datetime(2023, 9, 5)),
        ("1 January 2024", datetime(2024, 1, 1)),
        ("01/05/2024", datetime(2024, 1, 5)),
        ("2024-1-5", datetime(2024, 1, 5)),
        ("2024-03-19T12:00:00Z", datetime(2024, 3, 19)),
        ("2 days ago", datetime(2024, 3, 29)),
        ("1 month ago", datetime(2024, 2, 29)),
        ("3 weeks ago", datetime(2024, 3, 10)),
        ("5 hours ago", datetime(2024, 3, 30, 19)),
        ("2 Days ago", NOW),
        ("January 1", None), ("soon", None), ("", None), (None, None), ("99/99/2024", None),
    ],
)
def test_parse_article_date(evaluate, text, wanted):
    got = evaluate(lambda t, n: D.parse_article_date(t, n), [(text, NOW)], "t string, n timestamp")
    assert got == [wanted]


def test_default_year(evaluate):
    got = evaluate(lambda t, n: D.parse_article_date(t, n, 2020), [("January 1", NOW)], "t string, n timestamp")
    assert got == [datetime(2020, 1, 1)]


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("2 fortnights ago", "2024-03-31T00:00:00.000Z"),
        ("2 Days ago", "2024-03-29T00:00:00.000Z"),
        ("2024-03-19T12:00:00Z", "2024-03-19T12:00:00.000Z"),
        ("January 1, 2024", "2024-01-01T00:00:00.000Z"),
        ("soon", None), (None, None),
    ],
)
def test_iso_date(evaluate, text, wanted):
    assert evaluate(lambda t, n: D.iso_date(t, n), [(text, NOW)], "t string, n timestamp") == [wanted]
