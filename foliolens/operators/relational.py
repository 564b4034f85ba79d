"""Filters, order, limits, deduplication and relationships between article relations.

Rules for hot keys, used throughout:

* "first row per key" and "top n per key" are ``row_number() <= n`` windows with
  ``n`` at most 1000.  Spark limits each key inside every map task before the
  shuffle, so a key with a third of all rows sends at most ``n`` rows per task.
* counts are taken before joins, with map-side partial aggregation.
* a list per key is only built after a top-n limit, so it is bounded.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as X
from foliolens.session import stored

# Parts of a key whose first rows are found on their own, before those of the key.
SPREAD = 64
# Ids of one piece of an order that has nothing else to be cut by.
ID_RANGE = 65536
# Entries of one list; longer ones are given in numbered parts.
PART_SIZE = 1000


def checked_limit(max_posts: int) -> int:
    if max_posts < V.MIN_MAX_POSTS:
        raise ValueError(V.REQUEST_MESSAGES["max_posts"])
    return max_posts


# --- filters ------------------------------------------------------------------------


def tag_matches(tags: X.ColumnOrName, wanted: list[str]) -> Column:
    """True when any wanted tag and any article tag contain one another, ignoring case."""
    tags = X.as_column(tags)
    wanted_tags = F.array(*[F.lit(tag) for tag in wanted])
    return F.coalesce(
        F.exists(wanted_tags, lambda want: F.exists(tags, lambda tag: X.contains_ci_either(tag, want))),
        F.lit(False),
    )


def filter_tags(articles: DataFrame, wanted: list[str] | None) -> DataFrame:
    return articles.filter(tag_matches("tags", wanted)) if wanted else articles


def filter_dates(
    articles: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Inclusive range; articles without a readable date stay."""
    date, keep = F.col("published_at"), F.lit(True)
    if start is not None:
        keep = keep & (date >= F.lit(start))
    if end is not None:
        keep = keep & (date <= F.lit(end))
    return articles.filter(date.isNull() | keep)


def filter_premium(articles: DataFrame, premium_content: bool = False) -> DataFrame:
    return articles if premium_content else articles.filter(~F.coalesce("is_premium", F.lit(False)))


def filter_read_time(articles: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    minutes = F.coalesce(F.col("read_time"), F.lit(0))
    if low is not None:
        articles = articles.filter(minutes >= low)
    return articles.filter(minutes <= high) if high is not None else articles


# --- order and limits ---------------------------------------------------------------


def sort_order(sort_by: str = "latest", tie: str = "article_id") -> list[Column]:
    """Sort columns; undated articles go last and a unique column breaks ties."""
    if sort_by not in V.SORT_ORDERS:
        raise ValueError(V.REQUEST_MESSAGES["sort"])
    if sort_by == "popular":
        first = X.engagement("claps", "responses").desc()
    elif sort_by == "oldest":
        first = F.col("published_at").asc_nulls_last()
    else:
        first = F.col("published_at").desc_nulls_last()
    return [first, F.col(tie).asc()]


def sorted_articles(articles: DataFrame, sort_by: str = "latest", tie: str = "article_id") -> DataFrame:
    return articles.orderBy(*sort_order(sort_by, tie))


def limit_posts(
    articles: DataFrame,
    max_posts: int,
    sort_by: str = "latest",
    per: tuple[str, ...] = (),
    tie: str = "article_id",
    rank: str | None = None,
) -> DataFrame:
    """The first ``max_posts`` articles, overall or per key.

    Per key in two steps, of parts of the key and then of what they leave, so that a key
    with a third of all rows is spread over tasks and its last one gets few rows.
    """
    order, limit = sort_order(sort_by, tie), checked_limit(max_posts)
    if not per:
        return articles.orderBy(*order).limit(limit)
    name = rank or "_rank"
    parts = articles.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(SPREAD)))
    near = parts.withColumn("_near", F.row_number().over(Window.partitionBy(*per, "_part").orderBy(*order)))
    first = near.filter(F.col("_near") <= limit).drop("_near", "_part")
    ranked = first.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= limit)
    return kept if rank else kept.drop(name)


def _cut_order(articles: DataFrame, sort_by: str, tie: str) -> tuple[DataFrame, list[Column]]:
    """Adds ``_cut`` and ``_block``, which cut an order into short pieces, and says how the pieces follow.

    Pieces are days, numbers of reactions, or ranges of ids for undated articles.
    """
    if sort_by == "popular":
        cut = X.engagement("claps", "responses")
        before = [F.col("_cut").desc()]
    else:
        cut = F.date_trunc("day", "published_at")
        before = [F.col("_cut").asc_nulls_last() if sort_by == "oldest" else F.col("_cut").desc_nulls_last()]
    block = F.when(cut.isNull(), F.floor(F.col(tie) / ID_RANGE)).otherwise(0)
    return articles.withColumns({"_cut": cut, "_block": block}), [*before, F.col("_block")]


def numbered_posts(
    articles: DataFrame, per: str, sort_by: str = "latest", tie: str = "article_id", total: str | None = None
) -> DataFrame:
    """Adds ``_rank``, each article's place (from 1) among all of its key, and, as ``total``, how many the key has.

    A key is cut where its order is: into days, numbers of reactions, or ranges of ids for
    undated articles.  Only counts of these are accumulated per key, and rows are ordered
    inside them, so that no task orders a whole key.
    """
    order = sort_order(sort_by, tie)
    keyed, following = _cut_order(articles, sort_by, tie)
    whole = Window.partitionBy(per)
    earlier = whole.orderBy(*following).rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(per, "_cut", "_block").agg(F.count("*").alias("_count")).select(
        F.col(per).alias("_key"), F.col("_cut").alias("_day"), F.col("_block").alias("_ids"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_count").over(whole).alias("_total")] if total else []),
    )
    inside = keyed.withColumn("_inside", F.row_number().over(Window.partitionBy(per, "_cut", "_block").orderBy(*order)))
    same = (
        F.col(per).eqNullSafe(F.col("_key")) & F.col("_cut").eqNullSafe(F.col("_day")) & (F.col("_block") == F.col("_ids"))
    )
    return inside.join(offsets, same).select(
        *articles.columns, (F.col("_before") + F.col("_inside")).alias("_rank"),
        *([F.col("_total").alias(total)] if total else []),
    )


def filter_sort_limit(
    articles: DataFrame,
    tags: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    premium_content: bool = False,
    sort_by: str = "latest",
    max_posts: int | None = V.DEFAULT_MAX_POSTS,
    per: tuple[str, ...] = (),
    tie: str = "article_id",
) -> DataFrame:
    """Tags, then dates, then premium, then order and limit.  Errors surface."""
    kept = filter_premium(filter_dates(filter_tags(articles, tags), start, end), premium_content)
    if max_posts is None:
        return sorted_articles(kept, sort_by, tie)
    return limit_posts(kept, max_posts, sort_by, per, tie)


def paginate(articles: DataFrame, offset: int, limit: int, order: list[Column]) -> DataFrame:
    """One page of a fully ordered relation; ``order`` must end in a unique column."""
    return articles.orderBy(*order).offset(offset).limit(limit)


def paginate_by_place(
    articles: DataFrame, offset: int, limit: int, sort_by: str = "latest", tie: str = "article_id"
) -> DataFrame:
    """The same page, however deep, without bringing the rows before it into one task.

    Rows are counted by piece of the order (days, numbers of reactions, ranges of ids); only these
    counts are accumulated.  Only the pieces that hold a part of the page are joined and ordered.
    """
    keyed, following = _cut_order(articles, sort_by, tie)
    earlier = Window.orderBy(*following).rowsBetween(Window.unboundedPreceding, -1)
    pieces = keyed.groupBy("_cut", "_block").agg(F.count("*").alias("_count")).select(
        F.col("_cut").alias("_day"), F.col("_block").alias("_ids"), "_count",
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"),
    )
    wanted = pieces.filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_count") > offset))
    near = keyed.join(
        wanted.drop("_count"), F.col("_cut").eqNullSafe(F.col("_day")) & (F.col("_block") == F.col("_ids"))
    )
    inside = F.row_number().over(Window.partitionBy("_cut", "_block").orderBy(*sort_order(sort_by, tie)))
    placed = near.withColumn("_place", F.col("_before") + inside)
    page = placed.filter((F.col("_place") > offset) & (F.col("_place") <= offset + limit))
    return page.orderBy("_place").select(*articles.columns)


# --- batches ------------------------------------------------------------------------


def keep_first_by_url(items: DataFrame, order: tuple[str, ...] = ("batch", "index")) -> DataFrame:
    """The earliest item of every URL."""
    window = Window.partitionBy("url").orderBy(*order)
    return items.withColumn("_first", F.row_number().over(window)).filter("_first = 1").drop("_first")


def item_index(rows: DataFrame, items: str, name: str = "item") -> DataFrame:
    """One row per array item with its 0-based position, numbered inside the row."""
    keys = [column for column in rows.columns if column != items]
    return X.exploded(rows, keys, F.col(items), "item_index", name)


def merge_batches(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held items plus the new ones whose URL is not held, each URL once.

    Held items win.  One shuffle on the URL covers both the anti-join and the
    deduplication inside the new batch.
    """
    both = held.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)))
    return keep_first_by_url(both, ("_source", "batch", "index")).drop("_source")


def cumulative_batches(items: DataFrame, max_posts: int, per: str = "author") -> DataFrame:
    """``(per, batch, new_items, total_items, is_read)``: batches are read until the limit is met.

    Items are counted per batch first; only those counts are accumulated.
    """
    return _running_totals(keep_first_by_url(items), max_posts, per)


def _running_totals(fresh: DataFrame, max_posts: int, per: str) -> DataFrame:
    window = Window.partitionBy(per).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    counts = fresh.groupBy(per, "batch").agg(F.count("*").alias("new_items"))
    totals = counts.withColumn("total_items", F.sum("new_items").over(window))
    return totals.withColumn("is_read", F.col("total_items") - F.col("new_items") < max_posts)


def cumulative_until_limit(items: DataFrame, max_posts: int, per: str = "author") -> DataFrame:
    """The new items of every batch that is read before the limit is met.

    Items are deduplicated once: the first of every URL are stored in the shared folder, and
    both the counts of the batches and the result are read from there.
    """
    fresh = stored(keep_first_by_url(items), "first-items")
    last = (
        _running_totals(fresh, max_posts, per)
        .filter("is_read")
        .groupBy(F.col(per).alias("_key"))
        .agg(F.max("batch").alias("_last_batch"))
    )
    known = F.col(per).eqNullSafe(F.col("_key"))
    return fresh.join(last, known & (F.col("batch") <= F.col("_last_batch"))).drop("_key", "_last_batch")


# --- relationships ------------------------------------------------------------------


def listing_to_article(listing: DataFrame, articles: DataFrame) -> DataFrame:
    """Each listed URL with its article's fields; null where the article was not reached."""
    listed = keep_first_by_url(listing).select("url", "batch", "index")
    return listed.join(articles, "url", "left")


def not_reached(listing: DataFrame, articles: DataFrame) -> DataFrame:
    return keep_first_by_url(listing).join(articles.select("url"), "url", "left_anti")


def tags_backfill(listing: DataFrame, articles: DataFrame) -> DataFrame:
    """Listing items with the tags, counts and premium flag of their articles.

    Listings carry empty constants there, so filters only make sense afterwards.
    """
    known = articles.select(
        "url", *[F.col(name).alias(f"_{name}") for name in ("tags", "claps", "responses", "is_premium")]
    )
    joined = keep_first_by_url(listing).join(known, "url", "left")
    filled = {
        name: F.coalesce(F.col(f"_{name}"), F.col(name))
        for name in ("tags", "claps", "responses", "is_premium")
    }
    return joined.withColumns(filled).drop(*[f"_{name}" for name in filled])


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("article_id").agg(F.count("*").alias("comments_count"))


def article_comments(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Articles with their number of comments; zero is kept."""
    joined = articles.join(comment_counts(comments), "article_id", "left")
    return joined.withColumn("comments_count", F.coalesce("comments_count", F.lit(0).cast("bigint")))


def commented_articles(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Articles with at least one comment; each article id is sent once per map task."""
    return articles.join(comments.select("article_id").distinct(), "article_id", "left_semi")


def author_totals(articles: DataFrame, kept: Column, per: str = "author") -> DataFrame:
    """Articles per author before and after a filter."""
    return articles.groupBy(per).agg(
        F.count("*").alias("total_articles"), F.count_if(kept).alias("filtered_count")
    )


def author_articles(
    articles: DataFrame, fields: tuple[str, ...], part_size: int = PART_SIZE, sort_by: str = "latest"
) -> DataFrame:
    """All articles of every author in order, ``part_size`` to a row: ``(author, part, articles, total_articles)``."""
    ranked = numbered_posts(articles, "author", sort_by, total="_all")
    listed = ranked.groupBy("author", F.floor((F.col("_rank") - 1) / part_size).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("_rank", *fields))).alias("_listed"), F.max("_all").alias("total_articles")
    )
    return listed.select(
        "author", "part",
        F.transform("_listed", lambda item: F.struct(*[item[f].alias(f) for f in fields])).alias("articles"),
        "total_articles",
    )
