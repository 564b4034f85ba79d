"""Text functions: ``Column -> Column``, built from native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.fixed_values import (
    HTML_ESCAPES,
    MAX_SLUG_LENGTH,
    STOP_WORDS,
    WORDS_PER_MINUTE,
    ZERO_WIDTH,
)

# The whitespace of fixed_values.WS: as single characters, and as a class arranged so
# that a Java regex decides on ordinary characters with one range test.
WS_CHARACTERS = "".join(
    chr(code)
    for code in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
WS = (
    r"[\t\n\x0B\f\r \xA0[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
)

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def exploded(rows: DataFrame, keep: list, items: Column, position: str, item: str) -> DataFrame:
    """One row per array item with its 0-based position; rows without items vanish.

    ``posexplode`` would have Spark test the array's size below the projection that
    computes it, and so compute it twice; the outer form is filtered afterwards.
    """
    placed = rows.select(*keep, F.posexplode_outer(items).alias(position, item))
    return placed.filter(F.col(position).isNotNull()).withColumn(position, F.col(position).cast("bigint"))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once, even if rows are filtered on them later.

    Spark would push such a filter below the projection and repeat the work there.
    """
    packed = F.explode_outer(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return rows.select(*rows.columns, packed.alias("_computed")).select(*rows.columns, "_computed.*")


def text_or_empty(text: ColumnOrName) -> Column:
    return F.coalesce(as_column(text), F.lit(""))


def trim_ws(text: ColumnOrName) -> Column:
    """Strip every browser whitespace character from both ends.

    Most texts have none but spaces there, which two characters tell; stripping others looks at all of a text.
    """
    def at_end(value: Column) -> Column:
        return F.substring(value, 1, 1).isin(*WS_CHARACTERS) | F.substring(value, -1, 1).isin(*WS_CHARACTERS)

    return bind(
        F.trim(as_column(text)), lambda value: F.when(at_end(value), F.btrim(value, F.lit(WS_CHARACTERS))).otherwise(value)
    )


def collapse_ws(text: ColumnOrName) -> Column:
    """One space for every whitespace run, none at the ends.

    Single spaces, by far the most common run, are not matched at all.
    """
    runs = f"{WS}(?:(?<=[^ ]){WS}*+|{WS}++)"
    return F.trim(F.regexp_replace(text_or_empty(text), runs, " "))


def clean_text(text: ColumnOrName) -> Column:
    """Collapse whitespace runs, trim, then remove zero-width characters.

    Zero-width characters go last, so ``a <ZWSP> b`` keeps two spaces.
    """
    return F.trim(F.regexp_replace(collapse_ws(text), ZERO_WIDTH, ""))


def word_count(text: ColumnOrName) -> Column:
    """Number of whitespace-separated words: the spaces left after collapsing, plus one."""
    return _spaces_plus_one(collapse_ws(text))


def cleaned_word_count(text: ColumnOrName) -> Column:
    """Like :func:`word_count`, for a text that :func:`clean_text` has returned."""
    return _spaces_plus_one(F.regexp_replace(as_column(text), "  +", " "))


def _spaces_plus_one(collapsed: Column) -> Column:
    def counted(text: Column) -> Column:
        spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
        return (spaces + (text != "").cast("int")).cast("bigint")

    return bind(collapsed, counted)


def reading_minutes(text: ColumnOrName) -> Column:
    """Minutes named in a text such as ``5 min read`` or ``2 hours``; else 0."""
    found = F.regexp_extract(text_or_empty(text), rf"(?i)([0-9]+){WS}*(?:min|minute|hr|hour)", 0)
    amount = F.regexp_extract(found, r"^[0-9]+", 0).try_cast("bigint")
    factor = F.when(F.lower(found).rlike("hr|hour"), 60).otherwise(1)
    return F.coalesce(F.try_multiply(amount, factor.cast("bigint")), F.lit(0).cast("bigint"))


def estimate_minutes(text: ColumnOrName, words_per_minute: int = WORDS_PER_MINUTE) -> Column:
    return minutes_for_words(word_count(text), words_per_minute)


def minutes_for_words(words: ColumnOrName, words_per_minute: int = WORDS_PER_MINUTE) -> Column:
    return F.ceil(as_column(words) / F.lit(words_per_minute)).cast("bigint")


def file_slug(name: ColumnOrName) -> Column:
    value = text_or_empty(name)
    kept = F.regexp_replace(value, r'[<>:"/\\|?*]', "")
    joined = F.regexp_replace(kept, f"{WS}+", "_")
    undotted = F.regexp_replace(joined, r"^\.+|\.+$", "")
    slug = F.lower(F.substring(undotted, 1, MAX_SLUG_LENGTH))
    return F.when(value == "", F.lit("untitled")).otherwise(slug)


def truncate(text: ColumnOrName, max_length: int = 100, suffix: str = "...") -> Column:
    value = text_or_empty(text)
    kept = F.substring(value, 1, max(max_length - len(suffix), 0))
    return F.when(F.length(value) <= max_length, value).otherwise(F.concat(kept, F.lit(suffix)))


def hashtags(text: ColumnOrName) -> Column:
    """Lower-cased ``#word`` occurrences; repeats stay."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"#[0-9A-Za-z_]+"), F.lit(0))
    return F.transform(found, F.lower)


def mentions(text: ColumnOrName) -> Column:
    """Lower-cased ``@word`` occurrences; repeats stay, e-mail domains match too."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"@[0-9A-Za-z_]+"), F.lit(0))
    return F.transform(found, F.lower)


def domain(url: ColumnOrName) -> Column:
    """Lower-cased host without its first ``www.``; '' when the URL does not parse."""
    host = F.lower(F.try_parse_url(as_column(url), F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^(.*?)www\.", "$1"), F.lit(""))


def is_valid_url(url: ColumnOrName) -> Column:
    return F.try_parse_url(as_column(url), F.lit("PROTOCOL")).isNotNull()


def sentences(text: ColumnOrName) -> Column:
    """Runs of text up to and with their closing marks.

    The pattern also takes an unclosed tail, which is then dropped: looking for the
    closing mark again from every position of a long tail would be quadratic.
    """
    pieces = F.regexp_extract_all(text_or_empty(text), F.lit(r"[^.!?]++(?:[.!?]++|\z)"), F.lit(0))
    return F.filter(pieces, lambda piece: F.substring(piece, -1, 1).isin(".", "!", "?"))


def summary(text: ColumnOrName, max_sentences: int = 3) -> Column:
    """The first sentences joined by a space (their own leading space stays)."""
    value = text_or_empty(text)
    return bind(
        sentences(value),
        lambda found: F.when(F.size(found) <= max_sentences, trim_ws(value)).otherwise(
            trim_ws(F.array_join(F.slice(found, 1, max_sentences), " "))
        ),
    )


def digits_count(text: ColumnOrName) -> Column:
    """All digits of a text read as one number: ``12,345`` is 12345, ``1.2K`` is 12.

    No digits are 0; a number past BIGINT is null.
    """
    digits = F.regexp_replace(text_or_empty(text), "[^0-9]", "")
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))


def suffix_count(text: ColumnOrName) -> Column:
    """Like :func:`digits_count`, but ``1.2K`` is 1200 and ``3M`` is 3000000."""
    value = text_or_empty(text)
    scaled = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*[KM](?:[^A-Za-z]|$)"
    number = F.regexp_extract(F.regexp_replace(value, ",", ""), scaled, 1).try_cast("decimal(18,6)")
    factor = F.when(F.regexp_extract(value, scaled, 0).rlike("(?i)m"), 1_000_000).otherwise(1_000)
    return F.coalesce((number * factor).cast("bigint"), digits_count(value))


def contains_ci_either(left: ColumnOrName, right: ColumnOrName) -> Column:
    """True when either text contains the other, ignoring case."""
    a, b = F.lower(as_column(left)), F.lower(as_column(right))
    return F.contains(a, b) | F.contains(b, a)


def html_escape(text: ColumnOrName) -> Column:
    return reduce(
        lambda value, pair: F.replace(value, F.lit(pair[0]), F.lit(pair[1])),
        HTML_ESCAPES,
        text_or_empty(text),
    )


def csv_escape(text: ColumnOrName) -> Column:
    return F.replace(text_or_empty(text), F.lit('"'), F.lit('""'))


def engagement(claps: ColumnOrName, responses: ColumnOrName) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(as_column(claps), zero) + F.coalesce(as_column(responses), zero)


def percent(part: ColumnOrName, total: ColumnOrName) -> Column:
    """100 * part / total with two decimals, half away from zero; 0 without a total.

    Whole-number arithmetic keeps the last digit independent of binary rounding.
    """
    part, total = as_column(part).cast("decimal(20,0)"), as_column(total).cast("decimal(20,0)")
    doubled = F.lit(20000).cast("decimal(6,0)") * F.abs(part) + total
    hundredths = F.call_function("div", doubled, F.nullif(total * 2, F.lit(0).cast("decimal(1,0)")))
    signed = F.when(part < 0, -hundredths).otherwise(hundredths)
    return F.coalesce(signed.cast("decimal(36,0)") / 100, F.lit(0)).cast("decimal(38,2)")


def keyword_words(text: ColumnOrName) -> Column:
    """Candidate keywords of a text, in order of appearance."""
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[0-9a-z_]{3,}"), F.lit(0))
    return F.filter(found, lambda word: ~word.isin(*STOP_WORDS))


_KEYWORD_TABLE = "array<struct<word:string,n:bigint,first_rank:bigint>>"


def _run_starts(words: Column) -> Column:
    """Positions in a sorted array at which a new value begins."""
    return F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
    )


def _run_lengths(words: Column) -> Column:
    """How often each distinct value occurs, in sorted order."""
    return bind(
        F.sort_array(words),
        lambda in_order: bind(
            _run_starts(in_order),
            lambda starts: F.transform(
                starts, lambda start, j: F.coalesce(F.get(starts, j + 1), F.size(in_order)) - start
            ),
        ),
    )


def _counted(found: Column) -> Column:
    """Entries of the keyword table for a non-empty array of words."""
    ranked = F.sort_array(
        F.transform(F.array_distinct(found), lambda word, i: F.struct(word.alias("word"), i.alias("rank")))
    )
    return bind(
        _run_lengths(found),
        lambda counts: F.transform(
            ranked,
            lambda item, j: F.struct(
                item["word"].alias("word"),
                F.get(counts, j).cast("bigint").alias("n"),
                item["rank"].cast("bigint").alias("first_rank"),
            ),
        ),
    )


def keyword_table(text: ColumnOrName) -> Column:
    """``array<struct<word,n,first_rank>>``: one entry per distinct keyword of a text.

    ``first_rank`` numbers the keywords by first appearance.  A text is one row, so
    its words never have to leave it.  Sorting the words puts equal ones side by side;
    the lengths of the runs are the counts, in the order of the sorted distinct words.
    """
    return bind(
        keyword_words(text),
        lambda found: F.when(F.size(found) > 0, _counted(found)).otherwise(F.array().cast(_KEYWORD_TABLE)),
    )


def top_keywords(text: ColumnOrName, limit: int = 10) -> Column:
    """The most frequent keywords; ties go to the word that appears first."""
    ranked = F.sort_array(
        F.transform(
            keyword_table(text),
            lambda k: F.struct(
                (-k["n"]).alias("order"), k["first_rank"], k["word"].alias("word"), k["n"].alias("n")
            ),
        )
    )
    return F.slice(ranked, 1, limit)


def keywords(text: ColumnOrName, limit: int = 10) -> Column:
    return F.transform(top_keywords(text, limit), lambda k: k["word"])


def plain_text(content: ColumnOrName, title: ColumnOrName, subtitle: ColumnOrName) -> Column:
    """One readable text from a content struct; null content gives ''."""
    content, nothing = as_column(content), F.array().cast("array<string>")
    blank = F.array(F.lit(""))

    def when_text(value: Column, parts: Column) -> Column:
        return F.when(F.length(text_or_empty(value)) > 0, parts).otherwise(nothing)

    def each(items: Column, body) -> Column:
        return F.coalesce(F.flatten(F.transform(items, body)), nothing)

    title, subtitle = as_column(title), as_column(subtitle)
    quote_lines = each(
        content["quotes"],
        lambda quote: F.concat(
            F.array(F.concat(F.lit('"'), text_or_empty(quote["text"]), F.lit('"'))),
            when_text(quote["author"], F.array(F.concat(F.lit("— "), quote["author"]))),
            blank,
        ),
    )
    list_lines = each(
        content["lists"],
        lambda lst: F.concat(
            F.transform(
                lst["items"],
                lambda item, i: F.concat(
                    F.when(lst["type"] == "ol", F.concat((i + 1).cast("string"), F.lit(".")))
                    .otherwise(F.lit("•")),
                    F.lit(" "),
                    item,
                ),
            ),
            blank,
        ),
    )
    lines = F.concat(
        when_text(title, F.concat(F.array(title), blank)),
        when_text(subtitle, F.concat(F.array(subtitle), blank)),
        when_text(content["text_content"], F.array(content["text_content"])),
        F.coalesce(content["paragraphs"], nothing),
        quote_lines,
        list_lines,
    )
    return F.when(content.isNull(), F.lit("")).otherwise(trim_ws(F.array_join(lines, "\n")))
