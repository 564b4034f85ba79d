"""Access barriers: five cues per page, the type they add up to, and a confidence.

Barriers are only recognised; pages behind one are skipped, never opened.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import html as H, text as X
from foliolens.functions.tags import found_in

_BODY = (("article", "", "", ""), ("main", "", "", ""), ("*", "data-testid", "=", "articleContent"))


_PREMIUM_TEXTS = tuple(("span", text) for text in V.PREMIUM_SPAN_TEXTS)
_TEXTS = (*_PREMIUM_TEXTS, *V.MEMBER_TEXTS, *V.SUBSCRIPTION_TEXTS, *V.LOGIN_TEXTS)


# One look at a page: elements that may hold a text cue, and the body.
_CUTS = {
    "boxes": H.cut_for(tuple((tag, "", "", "") for tag in sorted({tag for tag, _ in _TEXTS})), outermost=True),
    "body": H.cut_for(_BODY, only_first=True),
}


def has_text_cue(plain: Column) -> Column:
    """Whether the text of a whole page holds one of the texts that are cues in some element."""
    return plain.rlike(H.any_text(tuple(sorted({text for _, text in _TEXTS}))))


def text_boxes(boxes: Column, cued: Column) -> Column:
    """Tag and text of the elements that may hold a text cue; none if the page's text holds no such text."""
    return F.when(cued, H.tag_texts(boxes))


def _any_text(boxes: Column, pairs) -> Column:
    by_tag: dict[str, list[str]] = {}
    for tag, text in pairs:
        by_tag.setdefault(tag, []).append(text)
    found = [
        F.exists(boxes, lambda box: (box["tag"] == tag) & box["text"].rlike(H.any_text(tuple(texts))))
        for tag, texts in by_tag.items()
    ]
    return F.coalesce(reduce(or_, found), F.lit(False))


def barrier_cues(markup: Column, boxes: Column, body: Column, compat: bool = False) -> Column:
    """One field per cue, in cleaned markup, its text boxes and its body: the cue's name if it is there, else null.

    With ``compat`` a text cue in a span counts but has no type, and the other
    text cues are not evaluated.
    """
    span_text = _any_text(boxes, _PREMIUM_TEXTS)
    premium_mark = H.has_element(markup, V.BARRIER_MARKS)
    member = H.has_element(markup, V.MEMBER_MARKS)
    subscription = H.has_element(markup, V.SUBSCRIPTION_MARKS)
    truncated = F.length(H.raw_text(body)) < V.TRUNCATION_THRESHOLD
    if compat:
        premium = F.when(span_text, F.lit("unknown")).when(premium_mark, F.lit("premium"))
        login = F.lit(False)
    else:
        premium = F.when(span_text | premium_mark, F.lit("premium"))
        member = member | _any_text(boxes, V.MEMBER_TEXTS)
        subscription = subscription | _any_text(boxes, V.SUBSCRIPTION_TEXTS)
        login = _any_text(boxes, V.LOGIN_TEXTS)
    return F.struct(
        premium.alias("premium"),
        F.when(member, F.lit("member_only")).alias("member_only"),
        F.when(subscription, F.lit("subscription_prompt")).alias("subscription_prompt"),
        F.when(truncated, F.lit("content_truncation")).alias("content_truncation"),
        F.when(login, F.lit("login_required")).alias("login_required"),
    )


def barrier_info(cues: Column) -> Column:
    """Type and confidence from the five cues."""
    active = F.array_compact(
        F.array(
            *[
                cues[name]
                for name in (
                    "premium", "member_only", "subscription_prompt", "content_truncation", "login_required",
                )
            ]
        )
    )
    kind = F.coalesce(
        *[F.when(F.array_contains(active, name), F.lit(name)) for name in V.BARRIER_TYPES],
        F.when(F.size(active) > 0, F.lit("unknown")),
    )
    confidence = F.least(F.size(active) * F.lit(V.CONFIDENCE_PER_INDICATOR), F.lit(1.0))
    return F.struct(
        kind.isNotNull().alias("has_barrier"),
        kind.alias("barrier_type"),
        active.alias("indicators"),
        confidence.cast("double").alias("confidence"),
    )


def barrier_classify(
    pages: DataFrame, *keep: str, compat: bool = False, **from_markup: Callable[[Column], Column]
) -> DataFrame:
    """``(page_id, url, *keep, *from_markup, has_barrier, barrier_type, indicators, confidence)``.

    ``from_markup`` are columns worked out from the cleaned markup while it is at hand.
    """
    cleaned = pages.select("page_id", "url", *keep, H.without_code("html").alias("markup"))
    if from_markup:
        built = {name: build(F.col("markup")) for name, build in from_markup.items()}
        cleaned, keep = X.computed(cleaned, **built), (*keep, *from_markup)
    markup, told = F.col("markup"), F.col("_told")
    plain = X.computed(cleaned, _cued=has_text_cue(H.raw_text("markup")))
    looked = plain.select(*plain.columns, found_in(markup, _CUTS, {"boxes": F.col("_cued")}).alias("_told"))
    read = X.computed(looked, _boxes=text_boxes(told["boxes"], F.col("_cued")))
    cues = barrier_cues(markup, F.col("_boxes"), H.first_of(told["body"]), compat)
    cued = read.select("page_id", "url", *keep, cues.alias("cues"))
    told = cued.select("page_id", "url", *keep, barrier_info(F.col("cues")).alias("b"))
    return told.select("page_id", "url", *keep, "b.*")


def barrier_skip(classified: DataFrame, premium_content: bool = False) -> DataFrame:
    """Drop pages behind a barrier unless premium content is wanted."""
    if premium_content:
        return classified
    return X.computed(classified, _hit=F.col("has_barrier")).filter(~F.col("_hit")).drop("_hit")
