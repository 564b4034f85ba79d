"""Loosely written dates to timestamps.  "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolens.functions.text import WS, ColumnOrName, as_column, bind, text_or_empty, trim_ws

_WORD = "[0-9A-Za-z_]"
_SECONDS = "map('second', 1L, 'minute', 60L, 'hour', 3600L, 'day', 86400L, 'week', 604800L)"
_MONTHS = "map('month', 1, 'year', 12)"


def _parsed(text: Column, pattern: str, written: str) -> Column:
    """The first match of ``pattern``, rewritten as month, day and year, read as a date.

    Month names count by their first three letters, in any case.
    """
    found = F.regexp_replace(F.regexp_extract(text, pattern, 0), f"^{pattern}$", written)
    return F.try_to_timestamp(F.initcap(found), F.lit("MMM d yyyy"))


def _named_month_dates(text: Column) -> Column:
    month = f"({_WORD}{{1,3}}){_WORD}*"
    month_first = rf"{month}{WS}+([0-9]{{1,2}}),{WS}+([0-9]{{4}})"
    day_first = rf"([0-9]{{1,2}}){WS}+{month}{WS}+([0-9]{{4}})"
    return F.coalesce(_parsed(text, month_first, "$1 $2 $3"), _parsed(text, day_first, "$2 $1 $3"))


def _yearless_date(text: Column, default_year: int | None) -> Column:
    if default_year is None:
        return F.lit(None).cast("timestamp")
    return _parsed(text, rf"({_WORD}{{1,3}}){_WORD}*{WS}+([0-9]{{1,2}})", f"$1 $2 {default_year}")


def _numeric_dates(text: Column) -> Column:
    slashed = F.regexp_extract(text, "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", 0)
    dashed = F.regexp_extract(text, "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", 0)
    return F.coalesce(
        F.try_to_timestamp(slashed, F.lit("M/d/yyyy")), F.try_to_timestamp(dashed, F.lit("yyyy-M-d"))
    )


def _whole_text(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(trim_ws(text), F.lit("")))


def _relative_date(text: Column, now: Column, any_case: bool) -> Column:
    """``N unit ago`` before ``now``; an unknown unit gives ``now``; else null."""
    pattern = rf"([0-9]+){WS}+({_WORD}+?)(s?){WS}+ago"

    def moved(found: Column) -> Column:
        amount = F.regexp_extract(found, pattern, 1).try_cast("int")
        unit = F.regexp_extract(found, pattern, 2)
        unit = F.lower(unit) if any_case else unit
        months = F.coalesce(F.try_element_at(F.expr(_MONTHS), unit), F.lit(0))
        seconds = F.coalesce(F.try_element_at(F.expr(_SECONDS), unit), F.lit(0))
        none = F.lit(0)
        step = F.try_make_interval(
            none, F.try_multiply(amount, months), none, none, none, none, F.try_multiply(seconds, amount.cast("bigint"))
        )
        return F.when(found != "", now - step)

    found = F.regexp_extract(text, pattern, 0)
    return bind(F.lower(found) if any_case else found, moved)


def parse_article_date(
    text: ColumnOrName, now: ColumnOrName, default_year: int | None = None
) -> Column:
    """First readable date in a text.  Times of day are dropped.

    A date without a year is null unless ``default_year`` is given.
    """
    now = as_column(now)
    return bind(
        text_or_empty(text),
        lambda value: F.coalesce(
            _named_month_dates(value),
            _yearless_date(value, default_year),
            _numeric_dates(value),
            _relative_date(value, now, any_case=False),
            _whole_text(value),
        ),
    )


def flexible_timestamp(text: ColumnOrName, now: ColumnOrName) -> Column:
    """Relative dates first (any case), then a full timestamp, then a date."""
    now = as_column(now)
    return bind(
        text_or_empty(text),
        lambda value: F.coalesce(
            _relative_date(value, now, any_case=True),
            _whole_text(value),
            _named_month_dates(value),
            _numeric_dates(value),
        ),
    )


def iso_format(timestamp: ColumnOrName) -> Column:
    return F.date_format(as_column(timestamp), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(text: ColumnOrName, now: ColumnOrName) -> Column:
    """ISO-8601 text with milliseconds.  Month arithmetic stays inside the month."""
    return iso_format(flexible_timestamp(text, now))


def calendar_timestamp(text: ColumnOrName) -> Column:
    """A full timestamp or a calendar date; relative dates are not read."""
    return bind(
        text_or_empty(text),
        lambda value: F.coalesce(_whole_text(value), _named_month_dates(value), _numeric_dates(value)),
    )
