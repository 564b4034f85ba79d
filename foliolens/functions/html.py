"""Reading HTML text with native expressions.

Markup is one string per row.  An *element* is the substring from its start tag to its
own end tag, also when elements of the same tag stand inside it, so its text is simply
the element without tags.  Elements are found in one pass: the markup is cut once at the
tags of the names asked for, depths are counted per name, and each start is matched with
the end at its depth.  The work grows with the markup, not with its square.

An element without an end tag ends at the next tag of its name.

Patterns take a tag to end at its first ``>``.  ``without_code`` makes that true: it reads odd
pages tag by tag, quotes included, and writes angle brackets that are no marks as references.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolens.fixed_values import HTML_ENTITIES
from foliolens.functions.tags import Cut, found_in
from foliolens.functions.text import ColumnOrName, as_column, bind, text_or_empty, trim_ws

_TAG_NAME = "[a-zA-Z][a-zA-Z0-9]*"
_VOID = ("img",)
# Start tags that end an open paragraph, as browsers do it.
_ENDS_PARAGRAPH = (
    "</(?:p|article|div|section|main|body|html|blockquote|li|ul|ol|td|nav|footer|header)|"
    "<(?:p|div|article|section|main|ul|ol|h[1-6]|blockquote|pre|table|nav|footer|header|hr|form)"
)
_ENDS_ITEM = "</(?:li|ul|ol)|<li"
# Tags between two looks at the whole result while depths are counted.
_CHUNK = 128


# What may stand in a tag after its name: a quoted value may hold brackets.  All repeats are
# possessive, so that long tags are read in one go.
IN_TAG = r"""(?:[^"'<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
# An angle bracket in a quoted value, or one that begins no tag, comment or declaration.
_ODD = r"""[=<](?:(?<==)\s*+(?:"[^"<>]*+[<>]|'[^'<>]*+[<>])|(?<=<)(?![a-zA-Z/!?]))"""
_TOKENS = "|".join((
    "<!--(?:.*?-->|.*)", rf"<script\b{IN_TAG}>(?:.*?</script\s*>|.*)", rf"<style\b{IN_TAG}>(?:.*?</style\s*>|.*)",
    rf"</?[a-z]{IN_TAG}>", "<[!?][^<>]*+>", "[^<]++", "<",
))


def tag_by_tag(html: ColumnOrName) -> Column:
    """Markup without code in which ``<`` and ``>`` only stand around tags, comments and declarations left out.

    Inside quoted values, and where a ``<`` begins nothing, they are written as references.
    """
    def token(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.char_length(piece) - 2)
        return (
            F.when(~F.startswith(piece, F.lit("<")), piece)
            .when(piece.rlike(r"(?i)^<(?:!|\?|(?:script|style)\b)"), F.lit(""))
            .when(piece.rlike("(?is)^</?[a-z].*>$"), F.concat(
                F.lit("<"), F.replace(F.replace(inner, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(">")
            ))
            .otherwise(F.lit("<"))
        )

    pieces = F.transform(F.regexp_extract_all(text_or_empty(html), F.lit(f"(?is){_TOKENS}"), F.lit(0)), token)
    # A bracket alone that a name follows is a tag cut off at the page's end; any other is text.
    return F.regexp_replace(F.array_join(pieces, ""), "<(?![a-zA-Z/])", "&lt;")


def without_code(html: ColumnOrName) -> Column:
    """Markup without comments, scripts and styles, whose text is not content.

    One that is never closed takes the rest of the page, as in browsers.  Most pages hold no angle
    bracket but around tags; only the others are read tag by tag.
    """
    plain = F.regexp_replace(
        text_or_empty(html),
        r"(?is)<(?:!--(?:.*?-->|.*)|script\b[^<>]*+>(?:.*?</script\s*>|.*)|style\b[^<>]*+>(?:.*?</style\s*>|.*))",
        "",
    )
    return F.when(as_column(html).rlike(_ODD), tag_by_tag(html)).otherwise(plain)


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named_references() -> dict[str, str]:
    """The named references of HTML 4, with the readings that fixed values give."""
    named = {name: chr(code) for name, code in name2codepoint.items()}
    return named | {old[1:-1]: new for old, new in HTML_ENTITIES if not old.startswith("&#")}


_REFERENCES = "map({})".format(
    ", ".join(f"{_sql_text(name)}, {_sql_text(value)}" for name, value in sorted(_named_references().items()))
)
_REFERENCE = "^(?:#[xX]([0-9a-fA-F]{1,8});?|#([0-9]{1,9});?|([a-zA-Z][a-zA-Z0-9]*);)"


# The code of a reference; that of a space for 160, which is read like its name.
_CODE = f"""
CASE WHEN regexp_extract(piece, {_sql_text(_REFERENCE)}, 1) <> ''
    THEN bigint(conv(regexp_extract(piece, {_sql_text(_REFERENCE)}, 1), 16, 10))
  WHEN regexp_extract(piece, {_sql_text(_REFERENCE)}, 2) <> '' THEN bigint(regexp_extract(piece, {_sql_text(_REFERENCE)}, 2))
END
"""
_CHARACTER = """
CASE WHEN code = 160 THEN ' ' WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN '\\uFFFD'
  ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END
"""
_DECODED = f"""
value -> CASE WHEN contains(value, '&') THEN array_join(transform(split(value, '&', -1), (piece, i) -> CASE
  WHEN i = 0 THEN piece
  WHEN startswith(piece, '#') THEN coalesce(
    transform(array({_CODE}), code -> CASE WHEN code IS NOT NULL THEN {_CHARACTER} END)[0]
      || regexp_replace(piece, {_sql_text(_REFERENCE)}, ''),
    '&' || piece)
  ELSE coalesce(
    try_element_at({_REFERENCES}, regexp_extract(piece, {_sql_text(_REFERENCE)}, 3))
      || regexp_replace(piece, {_sql_text(_REFERENCE)}, ''),
    '&' || piece)
END), '') ELSE value END
"""


def decode_entities(text: ColumnOrName) -> Column:
    """Character references, named, decimal and hexadecimal; others stay as they are."""
    return F.call_function("transform", F.array(as_column(text)), F.expr(_DECODED))[0]


def raw_text(markup: ColumnOrName, separator: str = "") -> Column:
    """Text of a piece of markup; ``separator`` stands in for each tag."""
    return decode_entities(F.regexp_replace(text_or_empty(markup), "<[^<>]*>", separator))


def element_text(markup: ColumnOrName, separator: str = "") -> Column:
    return trim_ws(raw_text(markup, separator))


def attribute(element: ColumnOrName, name: str) -> Column:
    """Value of an attribute of the element's own start tag; '' if absent."""
    pattern = rf"""(?i)^<[^<>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
    return bind(
        F.regexp_extract(as_column(element), "^<[^<>]*>", 0),
        lambda tag: decode_entities(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])),
    )


def _opening(tag: str) -> str:
    return _TAG_NAME if tag == "*" else re.escape(tag)


def _attribute_test(name: str, test: str, value: str) -> str:
    """Pattern for an attribute; values may stand in either quotes or in none."""
    quoted = f"(?-i:{re.escape(value)})"  # values, unlike names, keep their case
    body = {
        "=": rf"""(?:"{quoted}"|'{quoted}'|{quoted}(?=[\s>]))""",
        "*=": rf"""(?:"[^"<>]*{quoted}|'[^'<>]*{quoted}|[^\s"'<>]*{quoted})""",
        "~=": rf"""(?:"(?:[^"<>]*\s)?{quoted}(?:\s[^"<>]*)?"|'(?:[^'<>]*\s)?{quoted}(?:\s[^'<>]*)?'|{quoted}(?=[\s>]))""",
    }[test]
    return rf"{name}\s*=\s*{body}"


def _start_tag_test(spec: tuple[str, str, str, str]) -> str:
    """Pattern for a start tag after its ``<``."""
    return _any_test((spec,))


def _any_test(specs) -> str:
    """Pattern for a start tag, after its ``<``, that meets one of the specs; a name's attributes are looked for together."""
    by_tag: dict[str, dict[str, None]] = {}
    for tag, name, test, value in specs:
        by_tag.setdefault(tag, {})[_attribute_test(name, test, value) if name else ""] = None
    return "|".join(
        rf"{_opening(tag)}(?=[\s>/])" if "" in tests
        else rf"{_opening(tag)}\s(?:[^<>]*\s)?(?:{'|'.join(tests)})"
        for tag, tests in by_tag.items()
    )


def _split_specs(specs) -> tuple[list, list]:
    """Specs of single elements, and pairs (outer, inner) of elements inside others."""
    return [spec for spec in specs if len(spec) == 4], [spec for spec in specs if len(spec) == 2]


# The pass is written as SQL text: a lambda is parsed at once, where building it from
# Columns takes a call for every node.
# Depth of each event (name, at, step), sorted by name and place, among its name's
# elements: a start counts itself, an end the element it closes.  Running depths are kept
# chunk by chunk, so that long results are copied rarely.
_LEVELS = f"""
aggregate(
  transform(sequence(0, int(floor((size(ev) - 1) / {_CHUNK}))), c -> slice(ev, c * {_CHUNK} + 1, {_CHUNK})),
  named_struct('name', '', 'depth', 0, 'levels', array_repeat(0, 0)),
  (whole, chunk) -> transform(array(aggregate(
    chunk,
    named_struct('name', whole.name, 'depth', whole.depth, 'levels', array_repeat(0, 0)),
    (own, e) -> transform(array(if(own.name = e.name, own.depth, 0)), before -> named_struct(
      'name', e.name, 'depth', greatest(before + e.step, 0),
      'levels', concat(own.levels, array(if(e.step > 0, before + 1, before)))
    ))[0]
  )), own -> named_struct('name', own.name, 'depth', own.depth, 'levels', concat(whole.levels, own.levels)))[0]
).levels
"""

# Spans (at, until, closed, level) of all starts, in page order.  Sorted by name, depth and
# place, a start is followed by its own end; an unclosed one goes on to the event's ``next``.
_SPANS = f"""
transform(
  array(array_sort(zip_with(ev, {_LEVELS}, (e, level) -> named_struct(
    'name', e.name, 'level', level, 'at', e.at, 'step', e.step, 'next', e.next
  )))),
  placed -> array_sort(filter(
    transform(placed, (e, i) -> transform(
      array(coalesce(
        e.step > 0 AND get(placed, i + 1).name = e.name AND get(placed, i + 1).level = e.level
        AND get(placed, i + 1).step < 0, false
      )),
      closed -> named_struct(
        'at', e.at, 'until', if(closed, get(placed, i + 1).at, e.next), 'closed', closed,
        'level', if(e.step = 0, 0, e.level), 'starts', e.step >= 0
      )
    )[0]),
    one -> one.starts
  ))
)[0]
"""


_EVENTS = f"""
array_sort(filter(transform(pieces, (piece, i) -> named_struct(
  'name', lower(regexp_extract(piece, {_sql_text(f"^</?({_TAG_NAME})")}, 1)), 'at', i,
  'step', CASE WHEN startswith(piece, '</') THEN -1
    WHEN lower(regexp_extract(piece, {_sql_text(f"^</?({_TAG_NAME})")}, 1)) IN ({", ".join(map(_sql_text, _VOID))}) THEN 0
    ELSE 1 END,
  'next', i + 1
)), e -> e.at > 0))
"""
# Of a span: an image is its tag alone.
_MARKUP_OF = f"""
CASE WHEN s.level = 0 THEN regexp_extract(get(pieces, s.at), {_sql_text("^<[^<>]*>?")}, 0)
WHEN s.closed THEN concat(
  array_join(slice(pieces, s.at + 1, s.until - s.at), ''), regexp_extract(get(pieces, s.until), {_sql_text("^</[^<>]*>?")}, 0)
) ELSE array_join(slice(pieces, s.at + 1, s.until - s.at), '') END
"""


def _starts(place: str, tests: str) -> str:
    return f"get(pieces, {place}.at) RLIKE {_sql_text(f'(?is)^<(?:{tests})')}"


def _cut_at_names(looked_at: str) -> str:
    """The markup cut at all tags of the names whose start tags meet the tests, in this very markup."""
    start_names = _sql_text(rf"(?is)<(?={looked_at})({_TAG_NAME})")
    names = f"array_join(array_distinct(transform(regexp_extract_all(markup, {start_names}, 1), n -> lower(n))), '|')"
    pattern = f"concat('(?i)(?=</?(?:', {names}, {_sql_text(')[' + chr(92) + 's/>])')})"
    return f"split(concat(' ', markup), {pattern}, -1)"


def elements(html: ColumnOrName, specs, outermost: bool = False, only_first: bool = False) -> Column:
    """Every element that meets one of the specs, in page order, each from its start to its own end.

    A spec is ``(tag, attribute, test, value)``, or a pair of these for an inner element
    inside an outer one.  With ``outermost`` only elements that no element of the same
    tag name encloses, among the tags looked at.
    """
    single, nested = _split_specs(specs)
    outer, inner = [pair[0] for pair in nested], [pair[1] for pair in nested]
    looked_at, wanted = _any_test([*single, *outer, *inner]), _any_test([*single, *inner])
    meets = [_starts("s", _any_test(single))] if single else []
    for around, within in nested:
        meets.append(
            f"({_starts('s', _start_tag_test(within))} AND exists(spans, "
            f"box -> box.at < s.at AND s.at < box.until AND {_starts('box', _start_tag_test(around))}))"
        )
    test = f"({' OR '.join(meets)})" + (" AND s.level = 1" if outermost else "")
    tags = {spec[0] for spec in (*single, *outer, *inner)}
    if "*" in tags:
        cut = _cut_at_names(looked_at)
    else:
        # The leading space makes the first piece one without a tag.
        cut = f"split(concat(' ', markup), {_sql_text(rf'(?i)(?=</?(?:{'|'.join(sorted(tags))})[\s/>])')}, -1)"
    found = f"""
      transform(array({cut}), pieces -> transform(array({_EVENTS}), ev -> transform(array({_SPANS}), spans ->
        transform({f"slice(filter(spans, s -> {test}), 1, 1)" if only_first else f"filter(spans, s -> {test})"}, s -> {_MARKUP_OF})
      )[0])[0])[0]
    """
    body = F.expr(
        f"markup -> CASE WHEN markup RLIKE {_sql_text(f'(?is)<(?:{wanted})')} THEN {found} "
        "ELSE transform(array_repeat(0, 0), none -> '') END"
    )
    return F.call_function("transform", F.array(text_or_empty(html)), body)[0]


def cut_for(specs, outermost: bool = False, only_first: bool = False, inner: Cut | None = None) -> Cut:
    """The cut that finds what :func:`elements` does, for single specs."""
    if any(len(spec) != 4 for spec in specs):
        raise ValueError("cuts take no pairs of specs")
    names = frozenset(spec[0] for spec in specs)
    return Cut(_any_test(specs), None if "*" in names else names, outermost, only_first, inner=inner)


def cut_for_groups(groups: dict[str, tuple], every: tuple[str, ...] = ()) -> Cut:
    """The cut of :func:`element_groups`."""
    if any(len(spec) != 4 for specs in groups.values() for spec in specs):
        raise ValueError("groups take no pairs of specs")
    looked_at = _any_test([spec for specs in groups.values() for spec in specs])
    return Cut(
        looked_at, own_next=True, groups=tuple((name, _any_test(specs)) for name, specs in groups.items()),
        firsts=frozenset(groups) - frozenset(every),
    )


def page_elements(html: ColumnOrName, specs, outermost: bool = False, only_first: bool = False) -> Column:
    """:func:`elements` of whole pages, found in Arrow batches; not for use in lambdas."""
    return found_in(as_column(html), {"found": cut_for(specs, outermost, only_first)})["found"]


def element_groups(html: ColumnOrName, groups: dict[str, tuple], every: tuple[str, ...] = ()) -> Column:
    """Elements of several groups of specs from one cut of the markup: a struct with an array for each group.

    Of a group in ``every`` all elements in page order, of any other the first alone; an empty array if
    there is none, also for null markup.  Specs are those of :func:`elements`, without pairs.  An element
    without an end tag ends at the next tag of its name, or with the markup.  Found in Arrow batches; not
    for use in lambdas.
    """
    return found_in(as_column(html), {"found": cut_for_groups(groups, every)})["found"]


def first_of(found: Column) -> Column:
    """The first element of a group; '' if there is none."""
    return F.coalesce(F.get(found, 0), F.lit(""))


def first_element(html: ColumnOrName, specs) -> Column:
    """The first matching element's markup; '' if there is none."""
    return F.coalesce(F.get(elements(html, specs, only_first=True), 0), F.lit(""))


def has_element(html: ColumnOrName, specs) -> Column:
    return as_column(html).rlike(rf"(?is)<(?:{_any_test(specs)})")


def first_text(html: ColumnOrName, specs) -> Column:
    return element_text(first_element(html, specs))


def tag_elements(html: ColumnOrName, tag: str) -> Column:
    return elements(html, ((tag, "", "", ""),))


def start_tag_count(html: ColumnOrName, tag: str) -> Column:
    return F.regexp_count(as_column(html), F.lit(rf"(?i)<{tag}(?:[\s>/])"))


def all_paragraph_texts(html: ColumnOrName) -> Column:
    """Trimmed ``<p>`` texts; an unclosed paragraph ends at the next block."""
    pieces = F.split(as_column(html), r"(?i)<p(?:\s[^<>]*)?>", -1)
    inner = F.transform(
        F.filter(pieces, lambda _, i: i > 0),
        lambda piece: F.get(F.split(piece, rf"(?i)(?:{_ENDS_PARAGRAPH})[\s>]", 2), 0),
    )
    return F.transform(inner, lambda piece: element_text(piece))


def paragraph_texts(html: ColumnOrName) -> Column:
    return F.filter(all_paragraph_texts(html), lambda text: text != "")


def item_texts(html: ColumnOrName) -> Column:
    """Texts of all list items inside, nested ones also inside the text of their item.

    An unclosed item ends where the next item or the list's end stands.
    """
    return texts_of_items(tag_elements(html, "li"))


def texts_of_items(items: Column) -> Column:
    """The same for the items of a list."""
    def text(item: Column) -> Column:
        inner = F.regexp_replace(item, "^<[^<>]*>", "")
        cut = F.get(F.split(inner, rf"(?i)(?:{_ENDS_ITEM})[\s>]", 2), 0)
        return element_text(F.when(item.rlike(r"(?i)</li\s*>$"), item).otherwise(cut))

    return F.filter(F.transform(items, text), lambda item: item != "")


# List items with their depth.  Of each list tag: its level, and the level whose open item
# the text after the tag belongs to.  In order of level and place, an item's own text
# stands together, with that of lists inside it left out.
_LIST_ITEMS = f"""
markup -> transform(array(split(concat(' ', markup), {_sql_text('(?i)(?=</?(?:ul|ol|li)[' + chr(92) + 's/>])')}, -1)), pieces ->
  transform(array(filter(transform(pieces, (piece, i) -> named_struct(
    'name', 'list', 'at', i,
    'step', CASE WHEN lower(substr(piece, 1, 3)) IN ('<ul', '<ol') THEN 1
      WHEN lower(substr(piece, 1, 4)) IN ('</ul', '</ol') THEN -1 ELSE 0 END
  )), e -> e.at > 0)), ev ->
  transform(array(array_sort(flatten(zip_with(ev, {_LEVELS}, (e, level) -> transform(
    array(named_struct(
      'tag', lower(regexp_extract(get(pieces, e.at), '^</?([a-zA-Z]+)', 1)),
      'closes', startswith(get(pieces, e.at), '</'),
      'tail', regexp_replace(get(pieces, e.at), '^<[^<>]*>?', '')
    )),
    piece -> CASE
      WHEN piece.tag = 'li' AND NOT piece.closes THEN array(
        named_struct('level', level, 'at', e.at, 'role', 'item', 'text', piece.tail))
      WHEN piece.closes THEN array(
        named_struct('level', level, 'at', e.at, 'role', 'end', 'text', ''),
        named_struct('level', level - 1, 'at', e.at, 'role', 'text', 'text', piece.tail))
      ELSE array(
        named_struct('level', level, 'at', e.at, 'role', 'list', 'text', piece.tag),
        named_struct('level', level - 1, 'at', e.at, 'role', 'text', 'text', piece.tail))
    END
  )[0])))), parts ->
  transform(array(aggregate(
    transform(sequence(0, int(floor((size(parts) - 1) / {_CHUNK}))), c -> slice(parts, c * {_CHUNK} + 1, {_CHUNK})),
    named_struct('kind', '', 'item', {{none}}, 'done', array_repeat({{none}}, 0)),
    (whole, chunk) -> transform(array(aggregate(
      chunk,
      named_struct('kind', whole.kind, 'item', whole.item, 'done', array_repeat({{none}}, 0)),
      (own, part) -> CASE
        WHEN part.role = 'text' THEN named_struct(
          'kind', own.kind,
          'item', CASE WHEN own.item.open AND own.item.depth = part.level THEN named_struct(
            'at', own.item.at, 'depth', own.item.depth, 'kind', own.item.kind,
            'text', concat(own.item.text, part.text), 'open', true) ELSE own.item END,
          'done', own.done)
        WHEN part.role = 'item' THEN named_struct(
          'kind', own.kind,
          'item', named_struct('at', part.at, 'depth', part.level, 'kind', own.kind, 'text', part.text, 'open', part.level > 0),
          'done', CASE WHEN own.item.depth > 0 THEN concat(own.done, array(own.item)) ELSE own.done END)
        ELSE named_struct(
          'kind', CASE WHEN part.role = 'list' THEN part.text ELSE own.kind END,
          'item', named_struct('at', own.item.at, 'depth', own.item.depth, 'kind', own.item.kind, 'text', own.item.text, 'open', false),
          'done', own.done)
      END
    )), own -> named_struct('kind', own.kind, 'item', own.item, 'done', concat(whole.done, own.done)))[0]
  )), state -> array_sort(CASE WHEN state.item.depth > 0 THEN concat(state.done, array(state.item)) ELSE state.done END)
  )[0])[0])[0])[0]
""".replace("{none}", "named_struct('at', 0, 'depth', 0, 'kind', '', 'text', '', 'open', false)")


def list_items(html: ColumnOrName) -> Column:
    """All list items in page order: ``(depth, list_type, item)``, the text without that of lists inside.

    An item ends at its end tag, the next item of its list or the list's end; items outside
    of lists are left out.
    """
    found = F.call_function("transform", F.array(text_or_empty(html)), F.expr(_LIST_ITEMS))[0]
    return F.transform(found, lambda one: F.struct(
        one["depth"].alias("depth"), one["kind"].alias("list_type"), element_text(one["text"]).alias("item")
    ))


def absolute_url(href: ColumnOrName, page_url: ColumnOrName) -> Column:
    """Resolve relative hrefs against a page URL.

    The form of the href decides which leading part of the page URL is kept.
    """
    base = F.regexp_replace(as_column(page_url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(?=$|[?#])", "$1/")

    def resolved(link: Column) -> Column:
        kept = (
            F.when(link == "", r"(?s)^(.*)$")
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "^()")
            .when(F.startswith(link, F.lit("//")), "^([^:/]+:)")
            .when(F.startswith(link, F.lit("/")), "^([^:/]+://[^/?#]*)")
            .when(F.startswith(link, F.lit("#")), "^([^#]*)")
            .when(F.startswith(link, F.lit("?")), "^([^?#]*)")
            .otherwise("^([^:/]+://(?:[^/?#]*/)+)")
        )
        return F.concat(F.call_function("regexp_extract", base, kept, F.lit(1)), link)

    return bind(as_column(href), resolved)


def containers(html: ColumnOrName, specs) -> Column:
    """Whole elements of the given specs."""
    return elements(html, specs)


def any_text(texts: tuple[str, ...]) -> str:
    """Pattern for one of the texts."""
    return "|".join(re.escape(text).replace(r"\ ", " ") for text in texts)


def tag_texts(boxes: Column) -> Column:
    """``(tag, text)`` of elements, read through the tags in them."""
    return F.transform(boxes, lambda box: F.struct(
        F.lower(F.regexp_extract(box, f"^<({_TAG_NAME})", 1)).alias("tag"), raw_text(box).alias("text")
    ))
