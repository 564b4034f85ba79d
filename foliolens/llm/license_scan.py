r"""License scans: parts of texts compared with license templates.

Both are normalised to words (A-Z lower-cased, runs outside
``[\x00-\x2F\x3A-\x60\x7B-\x7F]``) and compared by the Dice coefficient of their sets of word
bigrams.  For a part with ``a`` bigrams only templates with between ``a t / (2 - t)`` and
``a (2 - t) / t`` of them can reach threshold ``t``; no other is looked at.  The parts of a text are
its lines, its blocks of lines between blank ones, and the whole; they are compared with the notices.

Spans are runs of neighbouring words anywhere in a text, over the ends of sentences, lines and blocks,
compared with the notices and with full licence texts.  A run starts and ends with a bigram
of its template, which loses nothing, as other bigrams at its ends only lower the coefficient, and
is at most ``(2 - t) / t`` times as long as it.  Of runs that overlap, that with the largest product of
coefficient and shared bigrams is given, so that a whole licence comes before a notice inside it.

Defined cases: a null or empty text and parts of less than two words match nothing; of
templates with equal coefficients the first name wins; a block that is one line, and a
text that is one block, count once; repeated rows each get a row; very long texts are
handled whole; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import whole_rows
from foliolens.llm.license_templates import MORE_NOTICES, TEMPLATES
from foliolens.llm.license_texts import FULL_TEXTS

THRESHOLD = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANK = re.compile(rb"\n(?:[ \t\r\x0b\x0c]*\n)+")
MATCHES = "array<struct<license:string,dice:double,part:string,number:int>>"
SPANS = "array<struct<license:string,dice:double,start:bigint,end:bigint>>"


def words(part: bytes) -> list[bytes]:
    return _WORD.findall(part.lower())


def bigrams(of: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(of, of[1:]))


class Templates:
    """Templates in order of size, and where each of their bigrams occurs."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        known = [(bigrams(words(text.encode())), name) for name, text in templates]
        known = sorted((len(held), name, sorted(held)) for held, name in known if held)
        self.sizes, self.names, self.threshold = [size for size, _, _ in known], [name for _, name, _ in known], threshold
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for number, (_, _, held) in enumerate(known):
            for pair in held:
                self.holders.setdefault(pair, []).append(number)

    def best(self, of: list[bytes]) -> tuple[float, str] | None:
        """The best template for a part, if it reaches the threshold."""
        held = bigrams(of)
        if not held:
            return None
        t, size = self.threshold, len(held)
        low = bisect_left(self.sizes, size * t / (2 - t) - 1e-9)
        high = bisect_right(self.sizes, size * (2 - t) / t + 1e-9)
        if low == high:
            return None
        shared = Counter(
            number for pair in held & self.holders.keys() for number in self.holders[pair] if low <= number < high
        )
        found = [(-2 * count / (size + self.sizes[number]), self.names[number]) for number, count in shared.items()]
        score, name = min(found, default=(0.0, ""))
        return (-score, name) if -score >= t else None


def parts(text: str | None) -> Iterator[tuple[str, int, bytes]]:
    """``(kind, number, part)``: lines, blocks of several lines, and a text of several blocks."""
    whole = (text or "").encode()
    for number, line in enumerate(whole.split(b"\n")):
        yield "line", number, line
    blocks = _BLANK.split(whole)
    for number, block in enumerate(blocks):
        if b"\n" in block.strip(b"\n"):
            yield "block", number, block
    if len(blocks) > 1:
        yield "text", 0, whole


def scan(text: str | None, templates: Templates) -> list[dict]:
    found = []
    for kind, number, part in parts(text):
        of = words(part)
        if len(of) > 1:
            best = templates.best(of)
            if best is not None:
                found.append({"license": best[1], "dice": best[0], "part": kind, "number": number})
    return found


class Runs:
    """Finds runs of words that are a template."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold, self.known = threshold, []
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for name, text in templates:
            of = words(text.encode())
            held = bigrams(of)
            for pair in held:
                self.holders.setdefault(pair, []).append(len(self.known))
            longest = int((len(of) - 1) * (2 - threshold) / threshold + 1e-9)
            # A run shares at least so many bigrams with the template as it needs with no other ones.
            self.known.append((name, held, longest, len(held) * threshold / (2 - threshold) - 1e-9))

    def found(self, of: list[bytes]) -> list[tuple[str, float, int, int]]:
        """``(name, coefficient, first word, last word)`` of runs that do not overlap, in order."""
        found, open_ = [], [(0, len(of))]
        # What lies between runs is looked at again: a run beaten there may have a shorter one.
        while open_:
            first, end = open_.pop()
            chosen = self._apart(of[first:end])
            found += [(name, dice, first + start, first + last) for name, dice, start, last in chosen]
            edges = [first, *[first + at for _, _, start, last in chosen for at in (start, last + 1)], end]
            if chosen:
                open_ += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a > 1]
        return sorted(found, key=lambda run: run[2])

    def _apart(self, of: list[bytes]) -> list[tuple[str, float, int, int]]:
        pairs = list(zip(of, of[1:]))
        shared = Counter(number for pair in self.holders.keys() & set(pairs) for number in self.holders[pair])
        wanted = [number for number, count in shared.items() if count >= self.known[number][3]]
        if not wanted:
            return []
        latest: dict[tuple[bytes, bytes], int] = {}
        before = np.empty(len(pairs), np.int64)
        for place, pair in enumerate(pairs):
            before[place] = latest.get(pair, -1)
            latest[pair] = place
        runs = []
        for number in wanted:
            runs += self._runs(number, pairs, before)
        runs.sort()
        used, chosen = bytearray(len(of)), []
        for _, _, start, end, name, dice in runs:
            if used.find(1, start, end + 1) < 0:
                used[start:end + 1] = b"\1" * (end + 1 - start)
                chosen.append((name, dice, start, end))
        return sorted(chosen, key=lambda run: run[2])

    def _runs(self, number: int, pairs: list, before: np.ndarray) -> Iterator[tuple]:
        """The best run of the template from each of its bigrams on."""
        name, held, longest, least = self.known[number]
        is_held = np.fromiter((pair in held for pair in pairs), bool, len(pairs))
        starts = np.flatnonzero(is_held)
        near = np.searchsorted(starts, starts + longest) - np.arange(len(starts))
        for start in starts[near >= least].tolist():
            new = before[start:start + longest] < start
            common = np.cumsum(new & is_held[start:start + longest])
            if common[-1] < least:
                continue
            dice = 2 * common / (np.cumsum(new) + len(held))
            # The last of equals: bigrams the run already has may follow.
            best = int(np.flatnonzero((dice == dice.max()) & is_held[start:start + longest])[-1])
            if dice[best] >= self.threshold:
                score = float(dice[best])
                yield -score * int(common[best]), -score, start, start + best + 1, name, score


def spans(text: str | None, runs: Runs) -> list[dict]:
    """Where in the text, in characters, its runs are."""
    whole = (text or "").encode()
    found = runs.found(words(whole))
    if not found:
        return []
    places = [(word.start(), word.end()) for word in _WORD.finditer(whole.lower())]
    return [
        {"license": name, "dice": dice, "start": len(whole[:places[first][0]].decode()),
         "end": len(whole[:places[last][1]].decode())}
        for name, dice, first, last in found
    ]


def license_scans(
    text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
    more: tuple[tuple[str, str], ...] = MORE_NOTICES + FULL_TEXTS,
) -> Column:
    """``matches``: each part of the text with the license it is, its best template at or above the threshold.
    ``spans``: the runs of words that are one of these or ``more`` templates."""
    match_fields = [("license", pa.string()), ("dice", pa.float64()), ("part", pa.string()), ("number", pa.int32())]
    span_fields = [("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]
    kind = pa.struct([("matches", pa.list_(pa.struct(match_fields))), ("spans", pa.list_(pa.struct(span_fields)))])

    @F.arrow_udf(f"struct<matches:{MATCHES},spans:{SPANS}>")
    def scans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, runs = Templates(templates, threshold), Runs(templates + more, threshold)
        for texts in batches:
            yield pa.array([
                {"matches": scan(text, own), "spans": spans(text, runs)} for text in (value.as_py() for value in texts)
            ], kind)

    return scans(text)


def scan_licenses(
    documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
    more: tuple[tuple[str, str], ...] = MORE_NOTICES + FULL_TEXTS,
) -> DataFrame:
    """Every input row as ``row`` with its ``matches`` and ``spans``, and the distinct names of each in
    order: ``licenses`` of the parts, ``span_licenses`` of the spans."""
    def names(of: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(of, lambda m: m["license"])))

    found = whole_rows(documents, scans=license_scans(F.col("text"), templates, threshold, more)).select(
        "row", "scans.matches", "scans.spans"
    )
    return found.withColumn("licenses", names("matches")).withColumn("span_licenses", names("spans"))
