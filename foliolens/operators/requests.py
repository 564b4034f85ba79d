"""Job requests: page routing, validation and defaults, all as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import dates, text as X


def page_type(url: X.ColumnOrName, site: str = V.SITE, strict: bool = False) -> Column:
    """``author``, ``article`` or ``unknown`` for a URL; author is tested first.

    With ``strict``, an author path that ends in ``-<hex id>`` is an article.
    """
    url = X.as_column(url)
    hex_tail = url.rlike("[/-][a-f0-9]{12,}$" if strict else "/[a-f0-9]{12,}$")
    is_post = F.contains(url, F.lit("/p/")) | hex_tail
    slugged = F.contains(url, F.lit(f"{site}/")) & F.contains(url, F.lit("-"))
    return (
        F.when(F.contains(url, F.lit("/@")) & ~is_post, "author")
        .when(is_post | F.contains(url, F.lit("/story/")) | slugged, "article")
        .otherwise("unknown")
    )


# Request fields: column, name in JSON, and the types of value it may have there.
_NUMBER, _TEXT, _FLAG = "(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "STRING", "BOOLEAN"
_FIELDS = (
    ("author_url", "authorUrl", _TEXT, "string"), ("max_posts", "maxPosts", _NUMBER, "double"),
    ("requests_per_second", "requestsPerSecond", _NUMBER, "double"), ("output_format", "outputFormat", _TEXT, "string"),
    ("sort_by", "sortBy", _TEXT, "string"), ("include_content", "includeContent", _FLAG, "boolean"),
    ("include_comments", "includeComments", _FLAG, "boolean"),
    ("include_publication", "includePublication", _FLAG, "boolean"), ("use_proxy", "useProxy", _FLAG, "boolean"),
    ("premium_content", "premiumContent", _FLAG, "boolean"),
)


def read_requests(texts: DataFrame, column: str = "input") -> DataFrame:
    """Request columns from JSON texts, beside ``wrong_types``: the columns whose value has a wrong type.

    A field that is not there is null and right; a null that is there is wrong.  A text that
    is no JSON, or null, is no input at all, and names the column ``input``.
    """
    keep = [name for name in texts.columns if name != column]
    parsed = texts.select(*keep, F.try_parse_json(F.col(column)).alias("_v"))
    given = F.col("_v")

    def at(path: str) -> Column:
        return F.try_variant_get(given, f"$.{path}", "variant")

    def kind(path: str) -> Column:
        return F.schema_of_variant(at(path))

    columns, wrong = {}, []
    for name, path, types, cast in _FIELDS:
        right = kind(path).rlike(f"^{types}$")
        columns[name] = F.when(right, F.try_variant_get(given, f"$.{path}", cast))
        wrong.append(F.when(~right, F.lit(name)))
    in_range = kind("dateRange").rlike("^(?:OBJECT|ARRAY)<")
    columns["date_range"] = F.struct(*[
        F.try_variant_get(given, f"$.dateRange.{end}", "string").alias(end) for end in ("start", "end")
    ])
    listed = kind("tags").rlike("^ARRAY<")
    entries = F.try_variant_get(given, "$.tags", "array<variant>")
    columns["tags"] = F.when(listed, F.transform(
        entries, lambda tag: F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get(tag, "$", "string"))
    ))
    wrong += [F.when(~in_range, F.lit("date_range")), F.when(~listed, F.lit("tags"))]
    wrong.append(F.when(F.coalesce(F.schema_of_variant(given) == "VOID", F.lit(True)), F.lit("input")))
    return parsed.select(
        *keep, *[value.alias(name) for name, value in columns.items()], F.array_compact(F.array(*wrong)).alias("wrong_types")
    )


def validate_requests(requests: DataFrame, site: str = V.SITE) -> DataFrame:
    """Adds ``errors`` (messages in rule order) and ``is_valid``; missing fields are fine.

    A column ``wrong_types``, as ``read_requests`` gives it, adds the fields it names.
    """
    messages = V.REQUEST_MESSAGES
    typed = "wrong_types" in requests.columns

    def mistyped(name: str) -> Column:
        return F.array_contains("wrong_types", name) if typed else F.lit(False)
    url = F.col("author_url")
    no_url = F.length(X.text_or_empty(url)) == 0
    host = F.try_parse_url(url, F.lit("HOST"))
    start, end = F.col("date_range.start"), F.col("date_range.end")

    def bad_date(text: Column) -> Column:
        return (F.length(text) > 0) & dates.calendar_timestamp(text).isNull()

    def outside(name: str, low, high) -> Column:
        return mistyped(name) | ~F.col(name).between(low, high)

    rules = {
        "url_missing": no_url,
        "url_host": ~no_url & host.isNotNull() & ~F.contains(F.lower(host), F.lit(site)),
        "url_format": ~no_url & host.isNull(),
        "max_posts": outside("max_posts", V.MIN_MAX_POSTS, V.MAX_MAX_POSTS),
        "rate": outside("requests_per_second", V.MIN_REQUESTS_PER_SECOND, V.MAX_REQUESTS_PER_SECOND),
        "format": mistyped("output_format") | ~F.col("output_format").isin(*V.OUTPUT_FORMATS),
        "sort": mistyped("sort_by") | ~F.col("sort_by").isin(*V.SORT_ORDERS),
        "range": mistyped("date_range"),
        "start": bad_date(start),
        "end": bad_date(end),
        "order": dates.calendar_timestamp(start) > dates.calendar_timestamp(end),
        "tags_list": mistyped("tags"),
        "tags": F.exists(F.col("tags"), lambda tag: tag.isNull() | (X.trim_ws(tag) == "")),
        **{
            name: mistyped(name)
            for name in ("include_content", "include_comments", "include_publication", "use_proxy", "premium_content")
        },
    }
    errors = F.array_compact(
        F.array(
            *[
                F.when(
                    broken,
                    F.lit(messages[name] if name != "url_host" else messages[name].replace(V.SITE, site)),
                )
                for name, broken in rules.items()
            ]
        )
    )
    errors = F.when(mistyped("input"), F.array(F.lit(messages["input"]))).otherwise(errors)
    return requests.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Trim and lower-case tags, trim the URL, and fill in defaults for missing fields."""
    defaults = {
        "max_posts": F.lit(V.DEFAULT_MAX_POSTS),
        "include_content": F.lit(True),
        "include_comments": F.lit(False),
        "include_publication": F.lit(True),
        "requests_per_second": F.lit(V.DEFAULT_REQUESTS_PER_SECOND),
        "use_proxy": F.lit(True),
        "output_format": F.lit("json"),
        "premium_content": F.lit(False),
        "sort_by": F.lit("latest"),
    }
    no_tags = F.array().cast("array<string>")
    tags = F.filter(
        F.transform(F.coalesce("tags", no_tags), lambda tag: F.lower(X.trim_ws(tag))), lambda tag: tag != ""
    )
    return requests.withColumns(
        {
            "author_url": X.trim_ws("author_url"),
            "tags": tags,
            **{name: F.coalesce(F.col(name), value) for name, value in defaults.items()},
        }
    )
