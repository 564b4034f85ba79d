"""Articles from the state object that pages embed as JSON.

The state is a flat map: key -> record, where records point at each other by key.
It is parsed once into ``map<string,string>`` (record text by key); only records
that are needed are parsed further, against an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens import schemas
from foliolens.functions import dates, html as H, text as X
from foliolens.functions.tags import found_in
from foliolens.operators import markup as M


# Braces inside braces that one pattern reads; deeper objects are read token by token.
_PATTERN_DEPTH = 16
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _nested_braces(depth: int) -> str:
    """Pattern of an object with at most ``depth`` levels of braces inside; it never steps back."""
    inside = rf"[^{{}}\"]++|{_STRING}" + (f"|{_nested_braces(depth - 1)}" if depth else "")
    return rf"\{{(?:{inside})*+\}}"


def balanced_object(text: Column) -> Column:
    """The object that the text begins with, up to the brace that closes it; null if none does.

    Braces inside quoted strings do not count.
    """
    pattern = rf"(?s)\A{_nested_braces(_PATTERN_DEPTH)}"
    return X.bind(text, lambda own: F.coalesce(
        F.nullif(F.regexp_extract(own, pattern, 0), F.lit("")), _balanced_by_token(own)
    ))


def _balanced_by_token(text: Column) -> Column:
    """The same for objects of any depth, and with quotes that are never closed."""
    # Strings and all between braces are one token each; a quote that is never closed is one alone.
    tokens = F.regexp_extract_all(text, F.lit(rf"""(?s){_STRING}|[{{}}"]|[^{{}}"]++"""), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        closes = (state["end"] == 0) & (token == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"), (state["at"] + 1).alias("at"), F.when(closes, state["at"] + 1).otherwise(state["end"]).alias("end")
        )

    return X.bind(tokens, lambda own: X.bind(
        F.aggregate(own, start, step, lambda state: state["end"]),
        lambda end: F.when(end > 0, F.array_join(F.slice(own, F.lit(1), end), "")),
    ))


def embedded_state(html: Column) -> Column:
    """Text of the embedded state object, up to the brace that closes it; else null.

    A script runs to the first end tag after it, so each piece of the page between end tags holds
    one at most; what follows the last end tag is no closed script.
    """
    marker = V.STATE_MARKER + r"\s*="
    pieces = F.split(html, r"(?i)</script\s*>", -1)
    marked = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda piece: piece.rlike(marker))
    scripts = F.transform(marked, lambda piece: F.regexp_extract(piece, rf"(?is)<script\b{H.IN_TAG}>(.*)$", 1))
    script = F.get(F.filter(scripts, lambda s: s.rlike(marker)), 0)
    body = F.nullif(F.regexp_extract(script, rf"(?s){marker}\s*(\{{.*)$", 1), F.lit(""))
    return balanced_object(body)


def state_map(state: Column) -> Column:
    """Record text by key; null when the object is not valid JSON."""
    return F.from_json(state, "map<string,string>")


def post_key(records: Column) -> Column:
    """Key of the article record: the first ``post(`` edge of the root record."""
    root = F.try_element_at(records, F.lit("ROOT_QUERY"))
    edge = F.get(
        F.filter(F.json_object_keys(root), lambda key: F.startswith(key, F.lit("post("))), 0
    )
    edges = F.from_json(root, "map<string,string>")
    return F.from_json(F.try_element_at(edges, edge), schemas.STATE_REF)["__ref"]


def post_record(records: Column) -> Column:
    return F.from_json(F.try_element_at(records, post_key(records)), schemas.STATE_POST)


def state_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, records, post)``; ``post`` is null when a page has no usable state."""
    found = pages.select("page_id", "url", embedded_state(F.col("html")).alias("state"))
    parsed = found.select("page_id", "url", "state", state_map(F.col("state")).alias("records"))
    return parsed.select(
        "page_id", "url", "records", post_record(F.col("records")).alias("post")
    )


def usable_state(found: DataFrame) -> DataFrame:
    """Pages whose state names an article.

    Written as an explode so that the test stays above the parsing; a plain filter
    is pushed below it and parses every page twice.
    """
    kept = X.exploded(found, ["page_id", "url", "records"], F.array("post"), "_", "post")
    return kept.filter(F.col("post").isNotNull()).drop("_")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _with_prefix(prefix: str, value: Column) -> Column:
    return F.when(F.length(_text(value)) > 0, F.concat(F.lit(prefix), value)).otherwise(F.lit(""))


def state_article(post: Column, page_url: Column, now: Column) -> Column:
    """Article fields from a post record; numeric dates and read times are kept."""
    written = F.coalesce(
        F.nullif(post["firstPublishedAt"], F.lit("")), F.nullif(post["createdAt"], F.lit(""))
    )
    is_number = written.rlike("^[0-9]{9,}$")
    published = F.when(is_number, F.timestamp_millis(written.try_cast("bigint"))).otherwise(
        dates.parse_article_date(written, now)
    )
    minutes = F.coalesce(
        post["readingTime"].try_cast("double"), X.reading_minutes(post["readingTime"]).cast("double")
    )
    zero = F.lit(0).cast("bigint")
    names = F.transform(
        F.coalesce(post["tags"], F.array().cast("array<struct<name:string>>")), lambda t: _text(t["name"])
    )
    return F.struct(
        X.clean_text(post["title"]).alias("title"),
        X.clean_text(post["subtitle"]).alias("subtitle"),
        X.clean_text(post["creator"]["name"]).alias("author"),
        _with_prefix(f"{V.SITE_URL}/@", post["creator"]["username"]).alias("author_url"),
        published.alias("published_at"),
        minutes.alias("read_time"),
        F.coalesce(post["clapCount"].try_cast("bigint"), zero).alias("claps"),
        F.coalesce(post["responseCount"].try_cast("bigint"), zero).alias("responses"),
        F.filter(names, lambda name: name != "").alias("tags"),
        F.struct(
            _text(post["collection"]["name"]).alias("name"),
            _with_prefix(f"{V.SITE_URL}/", post["collection"]["slug"]).alias("url"),
        ).alias("publication"),
        _with_prefix(f"{V.IMAGE_HOST_URL}/", post["previewImage"]["id"]).alias("main_image"),
        (F.coalesce(post["isLocked"], F.lit(False)) | F.coalesce(post["isMembers"], F.lit(False))).alias(
            "is_premium"
        ),
        page_url.alias("url"),
        F.when(
            post["sequence"].isNotNull(),
            F.struct(
                _text(post["sequence"]["title"]).alias("name"),
                _with_prefix(f"{V.SITE_URL}/sequence/", post["sequence"]["slug"]).alias("url"),
                _text(F.nullif(post["sequenceIndex"], F.lit("0"))).alias("part"),
            ),
        ).alias("series"),
    ).cast(schemas.ARTICLE)


def article_info(pages: DataFrame, now: Column) -> DataFrame:
    """``(page_id, article)``: from embedded state where usable, else from markup."""
    read = pages.select("page_id", "url", "html", state_map(embedded_state(F.col("html"))).alias("records"))
    found = read.select("page_id", "url", "html", post_record(F.col("records")).alias("post"))
    # Markup is cleaned only where it is read.
    parsed = found.select(
        "page_id", "url", "post", F.when(F.col("post").isNull(), H.without_code("html")).alias("markup")
    )
    return parsed.select(
        "page_id",
        F.when(F.col("post").isNotNull(), state_article(F.col("post"), F.col("url"), now))
        .otherwise(M.article_struct(F.col("markup"), F.col("url"), now))
        .alias("article"),
    )


def _blocks(records: Column, post: Column) -> Column:
    """Content blocks in the article's own order, then any it does not list."""
    listed = F.transform(
        F.coalesce(post["content"]["bodyModel"]["paragraphs"], F.array().cast("array<struct<__ref:string>>")),
        lambda p: p["__ref"],
    )
    stored = F.filter(F.map_keys(records), lambda key: F.startswith(key, F.lit("Paragraph:")))
    order = X.bind(
        stored,
        lambda keys: F.array_distinct(F.concat(F.array_intersect(listed, keys), keys)),
    )

    def block(key: Column) -> Column:
        return X.bind(F.from_json(F.try_element_at(records, key), schemas.STATE_BLOCK), described)

    def described(b: Column) -> Column:
        kind, text = b["type"], _text(b["text"])
        is_heading = kind.isin("H1", "H2", "H3", "H4")
        is_list = kind.isin("OL", "UL")
        image = F.from_json(F.try_element_at(records, b["metadata"]["__ref"]), schemas.STATE_IMAGE)
        no_text = is_list | kind.isin("PRE", "IMG")
        return F.struct(
            F.when(is_heading, "heading")
            .when(kind == "P", "paragraph")
            .when(kind == "BQ", "quote")
            .when(kind == "PRE", "code")
            .when(kind == "IMG", "image")
            .when(is_list, "list")
            .otherwise("unknown")
            .alias("type"),
            F.when(is_heading, F.substring(kind, 2, 1).cast("int")).alias("level"),
            F.when(no_text, F.lit("")).otherwise(text).alias("text"),
            F.when(
                kind == "PRE",
                F.coalesce(F.nullif(b["codeBlockMetadata"]["lang"], F.lit("")), F.lit("unknown")),
            ).alias("language"),
            F.when(kind == "PRE", text).alias("code"),
            F.when(kind == "IMG", _with_prefix(f"{V.IMAGE_HOST_URL}/", image["id"])).alias("src"),
            F.when(kind == "IMG", _text(image["alt"])).alias("alt"),
            F.when(is_list, F.lower(kind)).alias("list_type"),
            F.when(is_list, F.filter(F.split(text, "\n"), lambda item: item != "")).alias("items"),
        )

    return F.transform(order, block)


def state_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, url, blocks)`` of the pages whose state names an article."""
    usable = usable_state(state_pages(pages))
    return usable.select("page_id", "url", _blocks(F.col("records"), F.col("post")).alias("blocks"))


def content_of_blocks(blocks: Column) -> Column:
    """Blocks grouped by kind.

    The text is the headings, paragraphs, quotes and unknown blocks; code, lists
    and images carry none.
    """
    def of(kind: str, build) -> Column:
        return F.transform(F.filter(blocks, lambda b: b["type"] == kind), build)

    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda text: text != "")

    def content(text: Column) -> Column:
        return F.struct(
            text.alias("text_content"),
            of("heading", lambda b: F.struct(b["level"].alias("level"), b["text"].alias("text"))).alias("headings"),
            of("paragraph", lambda b: b["text"]).alias("paragraphs"),
            of("list", lambda b: F.struct(b["list_type"].alias("type"), b["items"].alias("items"))).alias("lists"),
            of("quote", lambda b: F.struct(b["text"].alias("text"), F.lit("").alias("author"))).alias("quotes"),
            of("code", lambda b: F.struct(b["language"].alias("language"), b["code"].alias("code"))).alias("code_blocks"),
            of(
                "image",
                lambda b: F.struct(b["src"].alias("src"), b["alt"].alias("alt"), F.lit("").alias("caption")),
            ).alias("images"),
            F.array().cast("array<struct<text:string,url:string,title:string>>").alias("links"),
            X.word_count(text).alias("word_count"),
        ).cast(schemas.CONTENT)

    return X.bind(X.clean_text(F.array_join(texts, " ")), content)


def state_content(pages: DataFrame) -> DataFrame:
    """``(page_id, url, content)`` of the pages whose state names an article."""
    return state_blocks(pages).select("page_id", "url", content_of_blocks(F.col("blocks")).alias("content"))


def state_deref(pages: DataFrame) -> DataFrame:
    """``(page_id, from_key, position, key, record)``: every edge with the record it points at.

    Edges never leave their page, so the record is looked up in the page's own map:
    one scan, one parse, no shuffle.  Edges to records a page lacks are dropped.
    """
    found = pages.select("page_id", state_map(embedded_state(F.col("html"))).alias("records"))
    pattern = F.lit(r'"__ref"\s*:\s*"((?:[^"\\]|\\.)*+)"')

    def edges(entry: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(entry["value"], pattern, F.lit(1)),
            lambda key, i: F.struct(
                entry["key"].alias("from_key"),
                i.cast("bigint").alias("position"),
                key.alias("key"),
                F.try_element_at("records", key).alias("record"),
            ),
        )

    every = F.flatten(F.transform(F.map_entries("records"), edges))
    placed = X.exploded(found, ["page_id"], every, "_", "edge").select("page_id", "edge.*")
    return placed.filter(F.col("record").isNotNull())


def assemble_article(
    pages: DataFrame,
    now: Column,
    include_content: bool = True,
    include_comments: bool = False,
    include_publication: bool = True,
    keep: tuple[str, ...] = (),
    cleaned: Column | None = None,
) -> DataFrame:
    """Article rows with the optional parts that were asked for, after the columns named in ``keep``.

    A part that is not asked for is never selected, so it is never extracted.  ``cleaned`` is the
    markup without code where it has been worked out already.
    """
    read = pages.select(
        "page_id", "url", *keep,
        embedded_state(F.col("html")).alias("state"),
        (H.without_code("html") if cleaned is None else cleaned).alias("markup"),
    ).select("page_id", "url", *keep, "markup", "state", state_map(F.col("state")).alias("records"))
    markup, url, post, told = F.col("markup"), F.col("url"), F.col("post"), F.col("told")
    read = read.select(
        "page_id", "url", *keep, "markup", "records", post_record(F.col("records")).alias("post")
    )
    # All that is looked for in a page's markup is found by one function, and so by one Python worker.
    cuts, asked = {"article": M.ARTICLE_CUT}, {"article": post.isNull()}
    if include_comments:
        cuts["comments"], asked["comments"] = M.COMMENT_CUT, M.has_comments(markup)
    if include_publication:
        cuts["publication"] = M.PUBLICATION_CUT
    if include_content:
        cuts |= M.CONTAINER_CUTS
        asked |= dict.fromkeys(M.CONTAINER_CUTS, post.isNull())
    read = read.select("page_id", "url", *keep, "markup", "records", "post", found_in(markup, cuts, asked).alias("told"))
    parts = {
        "article": F.when(post.isNotNull(), state_article(post, url, now)).otherwise(
            M.article_struct(F.when(post.isNull(), markup), url, now, told["article"])
        )
    }
    if include_comments:
        parts["comments"] = M.comment_structs(markup, url, told["comments"])
    if include_publication:
        parts["publication"] = M.publication_struct(markup, url, told["publication"])
    if not include_content:
        return read.select("page_id", *keep, *[column.alias(name) for name, column in parts.items()])
    # State first, as for the article's fields: its pages have their text nowhere else.
    # Step by step, as expressions nested this deep would be slow to analyse.
    found = read.select(
        "page_id", "url", *keep, *[column.alias(name) for name, column in parts.items()],
        F.when(post.isNotNull(), _blocks(F.col("records"), post)).alias("blocks"),
        F.when(post.isNull(), M.content_containers(markup, told)).alias("boxes"),
    )
    read_parts = found.select(
        "page_id", *keep, *parts, F.when(F.col("blocks").isNotNull(), content_of_blocks(F.col("blocks"))).alias("stated"),
        M.content_structs(F.col("boxes"), url).alias("contents"),
    )
    merged = F.when(F.col("contents").isNotNull(), M.flatten_content(F.col("contents")).cast(schemas.CONTENT))
    return read_parts.select("page_id", *keep, *parts, F.coalesce("stated", merged).alias("content"))
