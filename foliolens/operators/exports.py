"""Exports: fixed projections, summary rows, and distributed sinks.

Sinks write one file per task.  Where output is laid out by author, rows are
rebalanced: Spark splits an author with very many rows over several files and
packs small authors together.
"""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import dates, text as X

COMMENTS_PER_ROW = 1000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _listed(name: str, separator: str = "; ") -> Column:
    return F.coalesce(F.array_join(name, separator), F.lit(""))


def _yes_no(name: str) -> Column:
    return F.when(F.coalesce(name, F.lit(False)), "Yes").otherwise("No")


def preview(text: X.ColumnOrName) -> Column:
    """First 200 characters, always followed by ``...``; '' for an empty text."""
    value = X.text_or_empty(text)
    return F.when(value == "", F.lit("")).otherwise(
        F.concat(F.substring(value, 1, V.PREVIEW_LENGTH), F.lit("..."))
    )


ROW_FIELDS = {
    "subtitle": "string", "author_url": "string", "publication": "struct<name:string,url:string>",
    "main_image": "string", "series": "struct<name:string,part:string>", "word_count": "bigint",
    "keywords": "array<string>", "hashtags": "array<string>", "mentions": "array<string>",
    "preview": "string", "comments_count": "bigint", "barrier_type": "string", "read_time": "double",
}


def with_missing_fields(articles: DataFrame) -> DataFrame:
    """Adds null columns for optional article fields a relation does not have."""
    missing = {
        name: F.lit(None).cast(kind) for name, kind in ROW_FIELDS.items() if name not in articles.columns
    }
    return articles.withColumns(missing) if missing else articles


def export_rows(articles: DataFrame, scraped_at: str, *keep: str) -> DataFrame:
    """The 24-column export; extra columns named in ``keep`` come first."""
    values = (
        _text("title"), _text("subtitle"), _text("url"), _text("author"), _text("author_url"),
        F.coalesce(dates.iso_format("published_at"), F.lit("")),
        _number("read_time"), _number("claps"), _number("responses"), _listed("tags"),
        _text("publication.name"), _text("publication.url"), _text("main_image"), _yes_no("is_premium"),
        _text("series.name"), _text("series.part"), _number("word_count"), _listed("keywords"),
        _listed("hashtags"), _listed("mentions"), _text("preview"), _number("comments_count"),
        F.coalesce("barrier_type", F.lit("none")), F.lit(scraped_at),
    )
    columns = [value.alias(name) for value, name in zip(values, V.EXPORT_COLUMNS)]
    return with_missing_fields(articles).select(*keep, *columns)


def summary_row(stats: DataFrame, scraped_at: str) -> DataFrame:
    """The closing ``STATISTICS`` row from one row of run statistics.

    ``stats`` carries ``author_name`` and ``author_url`` next to the run counters.
    """
    told = F.format_string(
        "Total Articles: %d, Success Rate: %s%%, Paywall Rate: %s%%",
        "total_articles", F.col("success_rate").cast("string"), F.col("paywall_rate").cast("string"),
    )
    filled = {
        "Article Title": F.lit("STATISTICS"),
        "Author Name": F.coalesce("author_name", F.lit("Unknown")),
        "Author URL": F.coalesce("author_url", F.lit("")),
        "Word Count": F.col("total_articles").cast("string"),
        "Content Summary": told,
        "Comments Count": F.col("errors").cast("string"),
        "Paywall Type": F.format_string("Session Duration: %dms", "session_duration"),
        "Scraped At": F.lit(scraped_at),
    }
    return stats.select(*[filled.get(name, F.lit("")).alias(name) for name in V.EXPORT_COLUMNS])


def export_with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Export rows as text plus the summary, told apart by ``row_kind`` (0 rows, 1 summary).

    For a document with the summary last see ``sink_csv_report``, which sorts nothing.
    """
    as_text = rows.select(
        F.lit(0).alias("row_kind"),
        *[F.col(f"`{name}`").cast("string").alias(name) for name in V.EXPORT_COLUMNS],
    )
    return as_text.unionByName(summary.withColumn("row_kind", F.lit(1)))


def html_report_row(articles: DataFrame, key: str = "article_id", *keep: str) -> DataFrame:
    """One escaped ``<tr>`` of eleven cells per article."""
    articles = with_missing_fields(articles)
    cells = (
        X.html_escape("title"), X.html_escape("author"),
        X.html_escape(dates.iso_format("published_at")),
        _number("read_time").cast("string"), _number("claps").cast("string"),
        _number("responses").cast("string"), X.html_escape(F.array_join("tags", ", ")),
        X.html_escape("publication.name"), _yes_no("is_premium"),
        _number("word_count").cast("string"), X.html_escape("url"),
    )
    wrapped = [F.concat(F.lit("<td>"), cell, F.lit("</td>")) for cell in cells]
    return articles.select(key, *keep, F.concat(F.lit("<tr>"), *wrapped, F.lit("</tr>")).alias("row"))


def public_articles(articles: DataFrame) -> DataFrame:
    """Public names of the article fields; reading time as text."""
    return articles.select(
        "title", "author", F.coalesce("publication.name", F.lit("")).alias("publication"), "url", "content",
        "word_count", F.concat(F.col("read_time").cast("string"), F.lit(" min")).alias("read_time"),
        "is_premium", "tags", "scraped_at",
    )


def public_comments(comments: DataFrame) -> DataFrame:
    """Comments as lists under their article, at most 1000 to a row.

    ``comments_part`` numbers the rows of an article, so that an article with very
    many comments is written whole without ever being one huge row.
    """
    part = F.floor(F.col("index") / COMMENTS_PER_ROW).cast("bigint")
    listed = comments.groupBy("article_id", part.alias("comments_part")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "index", F.col("author").alias("user"), F.col("content").alias("comment"),
                    F.col("claps").alias("likes"),
                )
            )
        ).alias("_listed")
    )
    return listed.select(
        "article_id", "comments_part",
        F.transform(
            "_listed", lambda c: F.struct(c["user"].alias("user"), c["comment"].alias("comment"), c["likes"].alias("likes"))
        ).alias("comments"),
    )


def public_stats(articles: DataFrame, comments: DataFrame, time_taken: str) -> DataFrame:
    counted = articles.select(F.lit(1).alias("a"), F.lit(0).alias("c")).unionAll(
        comments.select(F.lit(0).alias("a"), F.lit(1).alias("c"))
    )
    return counted.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_articles_scraped"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_comments_scraped"),
    ).withColumn("time_taken", F.lit(time_taken))


BARE_CELLS = frozenset(
    {
        "Reading Time (minutes)", "Claps", "Responses", "Is Premium", "Word Count", "Comments Count",
        "Paywall Type",
    }
)


def csv_line(rows: DataFrame, *keep: str) -> DataFrame:
    """Each export row as one CSV line: texts quoted, numbers and flags bare."""
    cells = [
        F.col(f"`{name}`").cast("string")
        if name in BARE_CELLS
        else F.concat(F.lit('"'), X.csv_escape(F.col(f"`{name}`")), F.lit('"'))
        for name in V.EXPORT_COLUMNS
    ]
    return rows.select(*keep, F.concat_ws(",", *cells).alias("line"))


def file_stem(author: X.ColumnOrName, stamp: X.ColumnOrName) -> Column:
    """``<author slug>-<timestamp>`` with ``:`` and ``.`` of the timestamp as ``-``."""
    author = X.as_column(author)
    named = F.when(F.length(X.text_or_empty(author)) > 0, author).otherwise(F.lit("unknown-author"))
    return F.concat(X.file_slug(named), F.lit("-"), F.regexp_replace(X.as_column(stamp), "[:.]", "-"))


def export_format(name: X.ColumnOrName) -> Column:
    name = F.lower(X.as_column(name))
    return F.when(name.isin(*V.OUTPUT_FORMATS), name).otherwise(F.lit("json"))


# --- sinks --------------------------------------------------------------------------


def as_results(rows: DataFrame, kind: str, scraped_at: str) -> DataFrame:
    """Rows as result records: ``(type, data VARIANT, scraped_at)``."""
    return rows.select(
        F.lit(kind).alias("type"),
        F.parse_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("data"),
        F.lit(scraped_at).cast("timestamp").alias("scraped_at"),
    )


def sink_append(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("type").parquet(path)


def sink_json(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("append").option("ignoreNullFields", "false").json(path)


def sink_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header; inner quotes are doubled.  No rows give header-only files."""
    writer = rows.write.mode("append").option("header", True).option("quoteAll", True)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What ``sink_csv`` wrote, all columns as text.  CSV does not tell null from empty: both are empty."""
    schema = ", ".join(f"`{name}` string" for name in columns)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.csv(path).fillna("")


def sink_html_rows(report: DataFrame, path: str) -> None:
    """Report rows alone, as text; ``sink_html_report`` writes the whole document."""
    report.select("row").write.mode("append").text(path)


def sink_framed(
    lines: DataFrame,
    path: str,
    head: Callable[[dict], list[str]],
    foot: Callable[[dict], list[str]],
    empty: str,
    **totals: Column,
) -> dict:
    """Writes ``lines.line`` between a head and a foot that may name totals of the rows.

    The rows are written once, by all tasks, to ``rows``; ``totals`` (and ``n_lines``) are observed in
    that same write, and ``head`` and ``foot`` follow from them.  No row is sorted or gathered.
    Without rows the head is ``empty`` and there is no foot line.  The document is complete once
    its foot is, which comes last; its parts, read in the order head, rows, foot, are the document.
    A document that is there already is written anew: its foot goes first, and with it its mark.
    Returns the totals.
    """
    spark = lines.sparkSession

    def write_part(name: str, texts: list[str]) -> None:
        rows = spark.createDataFrame([(text,) for text in texts], "line string").coalesce(1)
        rows.write.mode("overwrite").text(f"{path}/{name}")

    _drop_part(spark, f"{path}/foot")
    seen = Observation()
    observed = lines.observe(seen, F.count(F.lit(1)).alias("n_lines"), *[c.alias(n) for n, c in totals.items()])
    observed.select("line").write.mode("overwrite").text(f"{path}/rows")
    counted = dict(seen.get)
    write_part("head", head(counted) if counted["n_lines"] else [empty])
    write_part("foot", foot(counted) if counted["n_lines"] else [])
    return counted


def _path_of(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _drop_part(spark: SparkSession, folder: str) -> None:
    path, system = _path_of(spark, folder)
    system.delete(path, True)


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """``(part, line)`` of a complete document: part 0 is the head, 1 the rows, 2 the foot."""
    mark, system = _path_of(spark, f"{path}/foot/_SUCCESS")
    if not system.exists(mark):
        raise ValueError(f"no complete document in {path}")
    parts = [
        spark.read.schema("line string").text(f"{path}/{name}").select(F.lit(i).cast("bigint").alias("part"), "line")
        for i, name in enumerate(("head", "rows", "foot"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sink_csv_report(rows: DataFrame, path: str, summary: Callable[[dict], dict[str, str]], **totals: Column) -> dict:
    """The 24 columns as a CSV document: a heading line, the rows, and the closing statistics line.

    ``summary`` gives the cells of that line from the totals, which are aggregates over ``rows``.
    """

    def closing(counted: dict) -> list[str]:
        cells = summary(counted)
        quoted = {"Author Name", "Author URL", "Content Summary", "Paywall Type", "Scraped At"}
        escaped = {name: cells.get(name, "").replace('"', '""') for name in V.EXPORT_COLUMNS}
        return [",".join(f'"{text}"' if name in quoted else text for name, text in escaped.items())]

    lines = csv_line(rows, *[name for name in rows.columns if name not in V.EXPORT_COLUMNS])
    return sink_framed(lines, path, lambda _: [",".join(V.EXPORT_COLUMNS)], closing, V.NO_ARTICLES, **totals)


def sink_html_report(
    articles: DataFrame, path: str, author_name: str | None, scraped_at: str,
    rates: Callable[[dict], dict], key: str = "article_id", **totals: Column,
) -> dict:
    """The report as an HTML document: title, totals, a table of eleven columns, one row per article.

    ``rates`` gives ``total_articles``, ``success_rate`` and ``paywall_rate`` from the totals, which
    are aggregates over ``articles``.
    """
    title = html.escape(f"{V.SITE_LABEL} Articles - {author_name or V.NO_AUTHOR}", quote=True)

    def head(counted: dict) -> list[str]:
        shown = rates(counted)
        told = {
            "Scraped At": scraped_at, "Total Articles": shown["total_articles"],
            "Success Rate": f"{shown['success_rate']}%", "Paywall Rate": f"{shown['paywall_rate']}%",
        }
        return [
            f'<html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>',
            *[f"<p><strong>{name}:</strong> {html.escape(str(value))}</p>" for name, value in told.items()],
            "<table><thead><tr>" + "".join(f"<th>{name}</th>" for name in V.REPORT_COLUMNS) + "</tr></thead><tbody>",
        ]

    lines = html_report_row(articles, key, *totals_columns(articles, key)).withColumnRenamed("row", "line")
    empty = f"<html><body><p>{V.NO_ARTICLES}</p></body></html>"
    return sink_framed(lines, path, head, lambda _: ["</tbody></table></body></html>"], empty, **totals)


def totals_columns(articles: DataFrame, key: str) -> list[str]:
    """Columns of the articles that totals may name."""
    return [name for name in ("is_premium", "barrier_type", "published_at", "scraped_at") if name in articles.columns and name != key]


def sink_by_author(rows: DataFrame, path: str, author: str = "author") -> None:
    """JSON lines in one folder per author slug, balanced over files."""
    slugged = rows.withColumn("author_slug", X.file_slug(author))
    balanced = slugged.hint("rebalance", "author_slug")
    balanced.write.mode("append").partitionBy("author_slug").json(path)
