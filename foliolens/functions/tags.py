"""The tag pass over whole pages, in Arrow batches.

The rules are those of ``html.elements`` and ``html.element_groups``: the markup is cut at the tags of
the names asked for, and each start is matched with its own end.  A tag is tested once per task: what
it meets is remembered by its text, so that the work grows with the markup.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>?")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])", re.A)
_VOID = ("img",)
# Characters of the tags remembered at a time by one cut; a tag counts as 100 at least.
_REMEMBERED = 500_000
# Bytes of texts that are looked at before what was found in them leaves the task.
_PART = 512 * 1024


def tags_of(markup: str | None) -> list[tuple[int, str]]:
    """Place and text of every tag."""
    return [(tag.start(), tag.group()) for tag in _TAG.finditer(markup or "")]


class _Known(dict):
    """What is known of tags, by their text; all is forgotten where it would get too large."""

    size = 0

    def __setitem__(self, tag: str, told):
        self.size += max(len(tag), 100)
        if self.size > _REMEMBERED:
            self.clear()
            self.size = max(len(tag), 100)
        super().__setitem__(tag, told)


@dataclass(frozen=True)
class Cut:
    """Elements to be found: those whose start tag meets ``wanted`` (a pattern after ``<``).

    The markup is cut at tags of ``names`` (those of the start tags that meet ``wanted`` if None).  An
    element without an end tag ends at the next of these tags; with ``own_next`` at the next of its own
    name, or with the markup.  ``groups`` tells patterns by name; without them all elements are one group.
    ``firsts`` are the groups of which only the first element is wanted.  ``inner`` is looked for in each
    element found.
    """

    wanted: str
    names: frozenset[str] | None = None
    outermost: bool = False
    only_first: bool = False
    own_next: bool = False
    groups: tuple[tuple[str, str], ...] = ()
    firsts: frozenset[str] = frozenset()
    inner: Cut | None = None

    def result_type(self) -> pa.DataType:
        if self.groups:
            return pa.struct([(name, pa.list_(pa.string())) for name, _ in self.groups])
        if self.inner:
            return pa.list_(pa.struct([("own", pa.string()), ("inner", self.inner.result_type())]))
        return pa.list_(pa.string())

    def ddl(self) -> str:
        if self.groups:
            return f"struct<{','.join(f'{name}:array<string>' for name, _ in self.groups)}>"
        return f"array<struct<own:string,inner:{self.inner.ddl()}>>" if self.inner else "array<string>"


class Finder:
    """One cut, applied to one piece of markup after another."""

    def __init__(self, cut: Cut):
        self.cut = cut
        self.tests = [re.compile(f"<(?:{test})", re.A | re.I | re.S) for test in (cut.wanted, *(test for _, test in cut.groups))]
        self.inner = Finder(cut.inner) if cut.inner else None
        self.known: dict[str, tuple[str, tuple[bool, ...]]] = _Known()

    def told(self, tag: str) -> tuple[str, tuple[bool, ...]]:
        """Name of a tag ('' if it is no whole one), and which tests a start tag meets."""
        told = self.known.get(tag)
        if told is None:
            name = _NAME.match(tag)
            met = () if tag.startswith("</") else tuple(test.match(tag) is not None for test in self.tests)
            told = self.known[tag] = (name[1].lower() if name else "", met)
        return told

    def spans(self, markup: str, tags: list[tuple[int, str]]) -> list[tuple[str, tuple[bool, ...]]]:
        """``(element, tests met)`` of the elements wanted, in page order."""
        cut, told = self.cut, self.told
        known = {tag: told(tag) for tag in {tag for _, tag in tags}}
        names = {name for name, met in known.values() if met and met[0]}
        if not names:
            return []
        names = cut.names or names
        events = [(at, tag, *known[tag]) for at, tag in tags if known[tag][0] in names]
        spans, starts, last = [], {}, {}
        for i, (at, tag, name, met) in enumerate(events):
            stack = starts.setdefault(name, [])
            if cut.own_next and name in last:
                last[name][1] = at
            if tag.startswith("</"):
                if stack:
                    stack.pop()[2] = at + len(tag)
                last.pop(name, None)
                continue
            until = len(markup) if cut.own_next or i + 1 == len(events) else events[i + 1][0]
            if name in _VOID:
                spans.append([at, until, at + len(tag), 0, met])
                continue
            span = [at, until, None, len(stack) + 1, met]
            spans.append(span)
            stack.append(span)
            last[name] = span
        found = [span for span in spans if span[4][0] and (not cut.outermost or span[3] == 1)]
        return [
            (markup[at:until if stop is None else stop], met)
            for at, until, stop, _, met in (found[:1] if cut.only_first else found)
        ]

    def __call__(self, markup: str | None, tags: list[tuple[int, str]] | None = None):
        """What the cut finds; ``tags`` are those of the markup where they have been listed already."""
        found = self.spans(markup, tags_of(markup) if tags is None else tags) if markup else []
        if self.cut.groups:
            grouped = {}
            for i, (name, _) in enumerate(self.cut.groups, 1):
                own = (element for element, met in found if met[i])
                grouped[name] = list(islice(own, 1 if name in self.cut.firsts else None))
            return grouped
        if self.inner:
            return [{"own": element, "inner": self.inner(element)} for element, _ in found]
        return [element for element, _ in found]


def _fields(cuts: dict[str, Cut]) -> tuple[str, pa.DataType]:
    ddl = ",".join(f"{name}:{cut.ddl()}" for name, cut in cuts.items())
    return f"struct<{ddl}>", pa.struct([(name, cut.result_type()) for name, cut in cuts.items()])


class _Finders:
    """Several cuts of one text; those left out, and those that no tag of the text meets, are not tried."""

    def __init__(self, cuts: dict[str, Cut]):
        self.finders = {name: Finder(cut) for name, cut in cuts.items()}
        self.meets: dict[str, tuple[str, ...]] = _Known()

    def _met(self, tag: str) -> tuple[str, ...]:
        met = self.meets.get(tag)
        if met is None:
            met = self.meets[tag] = tuple(name for name, find in self.finders.items() if any(find.told(tag)[1][:1]))
        return met

    def __call__(self, text: str | None, left_out: Collection[str] = ()) -> dict:
        tags = tags_of(text) if len(left_out) < len(self.finders) else []
        tried = {name for tag in {tag for _, tag in tags} for name in self._met(tag)}.difference(left_out)
        return {name: find(text, tags) if name in tried else find(None) for name, find in self.finders.items()}


def _parts(*columns: pa.Array) -> Iterator[list[list]]:
    """Rows of a batch as Python objects, ``_PART`` bytes at a time: a batch of large pages is never held whole."""
    n = len(columns[0])
    step = max(1, n * _PART // max(1, sum(column.nbytes for column in columns)))
    for at in range(0, n, step):
        yield [column.slice(at, step).to_pylist() for column in columns]


def found_in(markup: Column, cuts: dict[str, Cut], asked: dict[str, Column] | None = None) -> Column:
    """Of a text: a struct with what each cut finds in it; null is read as an empty text.

    A cut named in ``asked`` finds nothing where its condition does not hold.  A function that Spark calls
    by itself has a Python worker of its own in every task, so cuts of one text belong in one call.
    """
    ddl, kind = _fields(cuts)
    conditions = tuple(asked or ())

    @F.arrow_udf(ddl)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        find = _Finders(cuts)
        for batch in batches:
            for texts, *told in _parts(*(batch if conditions else (batch,))):
                left_out = ([name for name, holds in zip(conditions, row) if not holds] for row in zip(*told))
                yield pa.array([find(text, out) for text, out in zip(texts, left_out if told else repeat(()))], kind)

    return found(markup, *(asked or {}).values())


def found_in_each(pieces: Column, cuts: dict[str, Cut]) -> Column:
    """Of an array of texts: an array of structs with what each cut finds in each of them; null for null."""
    ddl, kind = _fields(cuts)

    @F.arrow_udf(f"array<{ddl}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _Finders(cuts)
        for batch in batches:
            for (rows,) in _parts(batch):
                yield pa.array(
                    [None if texts is None else [find(text) for text in texts] for texts in rows], pa.list_(kind)
                )

    return found(pieces)
