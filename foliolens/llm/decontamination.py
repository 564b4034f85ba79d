"""Benchmark decontamination with a positional inverted index.

The index holds one posting ``(term, doc_id, text_key, pos)`` for each occurrence of a
term.  A window of an item is looked up through its rarest terms: every posting of such
a term names a place where the item could begin (the posting's position less the term's
offset), and places named by all of them are kept.  A window that occurs several times, in one item
or in many, is looked up once, so that repeated words cost no more than their postings.  Only
documents with such places are opened, to compare the words of each window at its places.  All of
it is DataFrame code.

Words are maximal runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z
are lower-cased.  Positions count words from 1.

Defined cases: a null or empty text has no words, no hits and is clean; an item without
words matches nothing; items with equal texts each count by their own id, and a null item
id adds hits but no id; repeated document rows each get a row; empty tables give empty or
clean results; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliolens.functions.text import computed
from foliolens.llm.common import LOWER, UPPER, lower_az, small, stored, whole_rows

WINDOW = 13
# Terms of a window whose lists are intersected, rarest first.
PROBES = 3

# Breaks between words, before A-Z are lower-cased.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _framed_words(text: Column) -> Column:
    """The words between two empty entries, so that word ``i`` is entry ``i`` counted from 0."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _BREAKS)


def item_words(benchmark: DataFrame) -> DataFrame:
    """Distinct item texts with words: ``(item_key, words, n, width, ids)``."""
    texts = computed(
        benchmark.select("item_id", "text"),
        _framed=F.transform(_framed_words(F.col("text")), lambda word: F.translate(word, UPPER, LOWER)),
    )
    words = texts.select(
        "item_id", F.slice("_framed", F.lit(2), F.size("_framed") - 2).alias("words")
    ).filter(F.size("words") > 0)
    return words.groupBy("words").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    ).select(F.xxhash64("words").alias("item_key"), "words", F.size("words").alias("n"), "ids")


def build_index(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings ``(term, doc_id, text_key, pos)``; ``terms`` limits which terms are kept.

    A term is kept as its 64-bit hash: a collision adds a candidate, which the comparison
    of the words then refuses.  A document is known by its id and the hash of its text.
    """
    placed = documents.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.posexplode(_framed_words(F.col("text"))).alias("pos", "word"),
    ).filter(F.col("word") != "")
    postings = placed.select(F.xxhash64(lower_az(F.col("word"))).alias("term"), "doc_id", "text_key", "pos")
    if terms is not None:
        postings = postings.join(small(terms.select("term").distinct()), "term", "left_semi")
    return stored(postings, "postings")


def item_terms(items: DataFrame) -> DataFrame:
    return items.select("item_key", "n", F.posexplode("words").alias("place", "word")).select(
        "item_key", "n", (F.col("place") + 1).alias("place"), F.xxhash64("word").alias("term")
    )


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows ``(item_key, start, words, ids)``: the first place of each, and the items that hold it."""
    width = F.least(F.lit(window), F.col("n"))
    each = items.select("item_key", "ids", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("n") - width + 1),
        lambda start: F.struct(start.alias("start"), F.slice("words", start, width).alias("words")),
    )).alias("window"))
    return each.groupBy("window.words").agg(
        F.min(F.struct("item_key", F.col("window.start").alias("start"))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"),
    ).select("first.item_key", "first.start", "words", "ids")


def rarest_terms(terms: DataFrame, frequencies: DataFrame, windows: DataFrame, window: int, probes: int) -> DataFrame:
    """Places of an item to look up: the rarest ``probes`` of each distinct window, ``(item_key, place, term,
    starts, needed)``, with the windows that ask for them.

    A window with a term that no document holds occurs nowhere and asks for nothing.
    """
    width = F.least(F.lit(window), F.col("n"))
    counted = terms.join(frequencies, "term", "left").select(
        "item_key", "place", "term", width.alias("width"), F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("place") - width + 1),
                             F.least(F.col("place"), F.col("n") - width + 1))).alias("start"),
    ).join(windows.select("item_key", "start"), ["item_key", "start"], "left_semi")
    one_window = Window.partitionBy("item_key", "start")
    ranked = counted.select(
        "*", F.min("frequency").over(one_window).alias("least"),
        F.row_number().over(one_window.orderBy("frequency", "place")).alias("rank"),
    )
    return ranked.filter((F.col("least") > 0) & (F.col("rank") <= probes)).groupBy("item_key", "place", "term").agg(
        F.collect_list("start").alias("starts"), F.least(F.lit(probes), F.min("width")).alias("needed")
    )


def candidates(
    index: DataFrame, items: DataFrame, windows: DataFrame, window: int = WINDOW, probes: int = PROBES
) -> DataFrame:
    """Where windows may occur: ``(doc_id, text_key, item_key, start, places)``, the word numbers where they would begin."""
    terms = item_terms(items)
    frequencies = index.groupBy("term").agg(F.count("*").alias("frequency"))
    lookups = stored(rarest_terms(terms, frequencies, windows, window, probes), "lookups")
    agreeing = index.join(small(lookups), "term").groupBy(
        "doc_id", "text_key", "item_key", (F.col("pos") - F.col("place")).alias("before")
    ).agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"), F.max("needed").alias("needed"))
    # A window is named as often as its terms agree; in order, its names stand together.
    named = F.array_distinct(F.filter(
        "starts", lambda start, i: F.coalesce(F.get("starts", i + F.col("needed") - 1) == start, F.lit(False))
    ))
    return agreeing.select("doc_id", "text_key", "item_key", "before", F.explode(named).alias("start")).groupBy(
        "doc_id", "text_key", "item_key", "start"
    ).agg(F.collect_list(F.col("before") + F.col("start")).alias("places"))


def phrase_matches(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES, slop: int = 0
) -> DataFrame:
    """Every input row as ``row`` with ``n_words`` and ``matches``: ``(ids, start, width)`` of each occurring window.

    With ``slop`` over 0, a proximity match: the window's rarest term stands in its place and
    each other term at most ``slop`` words from its own.
    """
    items = stored(item_words(benchmark), "items")
    windows = stored(item_windows(items, window), "windows")
    index = build_index(documents, item_terms(items))
    # One list names the place of a proximity match; the others need not agree on it exactly.
    found = candidates(index, items, windows, window, probes if slop == 0 else 1)
    per_document = found.join(small(windows, 50_000), ["item_key", "start"]).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("ids", "words", "places")).alias("candidates")
    ).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "candidates")
    rows = whole_rows(documents, text=F.col("text"), doc_id=F.col("doc_id"), text_key=F.xxhash64("text"))
    opened = rows.join(
        per_document,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left",
    )
    split = computed(opened.select("row", "text", "candidates"), _framed=_framed_words(F.col("text")))
    lowered = F.when(
        F.col("candidates").isNotNull(), F.transform("_framed", lambda word: F.translate(word, UPPER, LOWER))
    )
    ready = computed(split.select("row", "candidates", "_framed"), _words=lowered)

    def occurs(candidate: Column, place: Column, width: Column) -> Column:
        if slop == 0:
            return F.slice("_words", place + 1, width) == candidate["words"]
        return F.forall(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.array_contains(
                F.slice("_words", F.greatest(F.lit(1), place + i - slop) + 1, F.lit(2 * slop + 1)),
                F.element_at(candidate["words"], i + 1),
            ),
        )

    def occurring(candidate: Column) -> Column:
        width = F.size(candidate["words"])
        # Only places that leave the whole window inside the document.
        inside = F.filter(
            candidate["places"],
            lambda place: (place >= 1) & (place + width <= F.size("_words") - 1) & occurs(candidate, place, width),
        )
        return F.transform(inside, lambda place: F.struct(
            candidate["ids"].alias("ids"), place.alias("start"), width.alias("width")
        ))

    matches = F.flatten(F.transform("candidates", occurring))
    return computed(
        ready.select("row", (F.size("_framed") - 2).cast("bigint").alias("n_words"), "candidates", "_words"),
        matches=matches,
    ).select("row", "n_words", "matches")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, n_words, n_hit, item_ids, contaminated)`` for every document.

    A word inside any occurrence of a window is hit; a document is contaminated when
    at least a twentieth of its words are.
    """
    found = phrase_matches(documents, benchmark, window)
    hit = F.size(F.array_distinct(F.flatten(F.transform(
        "matches", lambda m: F.sequence(m["start"], m["start"] + m["width"] - 1)
    ))))
    counted = computed(
        found,
        n_hit=F.greatest(hit, F.lit(0)).cast("bigint"),
        item_ids=F.coalesce(
            F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["ids"])))),
            F.array().cast("array<string>"),
        ),
    )
    return counted.select(
        "row", "n_words", "n_hit", "item_ids",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return contamination(documents, benchmark, window).filter(~F.col("contaminated")).select("row.*")
