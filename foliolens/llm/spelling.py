r"""Spelling variants of the words of a corpus, found by walking a trie that is a table.

The trie is a relation of edges ``(node, letter, child, onward, child_n, node_n)``; a node is the
string that leads to it.  A frontier of states ``(word, position, node, edits)`` is joined with the
edges of one depth after the other.  A state without edits takes any edge as an inserted or
replaced letter, or skips a letter of its own; a state with its one edit only follows its word.
States that have used up their word on a node that ends a word are neighbours.

Each word stands in the trie twice, forwards behind ``>`` and backwards behind ``<``.  One edit
leaves a half of the word as it is: it either stands after the first half or, read backwards, after
the second.  So walks start in the middle, at a word's own node, where few edges are left, and no
word's first letters are ever joined.  An edge names the letters that go on from its child, so
states that could not take another step are not made.

Words of more than ``TRIE_LENGTH`` code points would ask for as many rounds.  They are compared by
their hashes with one letter left out instead, with the letters themselves compared after.

Defined cases: a null or empty text has no words; a null ``doc_id`` counts as an empty one where the
letter to delete is drawn; repeated rows count again; ties go to the word that is smaller in
code-point order; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import lower_az, small, stored

MIN_LENGTH = 6
MIN_COUNT = 5
# A form occurs at least so many times as often as its variant.
RATIO = 5
# One in so many distinct words of a document loses a letter.
NOISE = 199
TRIE_LENGTH = 40

FORWARDS, BACKWARDS = ">", "<"
STATE = "struct<position:int,node:string,near_n:bigint>"


def misspelt(word: Column, doc_id: Column, noise: int = NOISE) -> Column:
    """The word, without one letter where the hash of document and word says so."""
    drawn = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    place = F.pmod(drawn, F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))
    return F.when(F.pmod(drawn, F.lit(noise)) == 0, cut).otherwise(word)


def dictionary(documents: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all documents."""
    runs = documents.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run")
    )
    words = runs.select(misspelt(lower_az(F.col("run")), F.col("doc_id"), noise).alias("word"))
    # Filtered after counting: a filter before it would work out the drawn letter twice.
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(
        (F.col("n") >= min_count) & (F.char_length("word") >= min_length)
    )


def both_ways(words: DataFrame) -> DataFrame:
    """``(word, length, begin, n)``: each word forwards and backwards behind a mark; its walk begins at depth ``begin``."""
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    ways = F.array(
        F.struct(F.concat(F.lit(FORWARDS), "word").alias("word"), (half + 1).alias("begin")),
        F.struct(F.concat(F.lit(BACKWARDS), F.reverse("word")).alias("word"), (length - half + 1).alias("begin")),
    )
    return words.select(F.explode(ways).alias("way"), (length + 1).alias("length"), "n").select("way.word", "length", "way.begin", "n")


def edge_table(ways: DataFrame, top: int) -> DataFrame:
    """``(depth, node, letter, child, onward, child_n, node_n)`` from the depth ``top`` on, where the first walk begins.

    ``onward`` has the letters that go on from the child, ``child_n`` and ``node_n`` the counts of the words that
    end there, if any.
    """
    paths = ways.select(
        F.explode(F.sequence(F.lit(top), F.col("length"))).alias("depth"), "word", "length", "n"
    ).select(
        "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"),
        F.when(F.col("depth") < F.col("length"), F.substring("word", F.col("depth") + 1, F.lit(1))).alias("letter"),
        F.when(F.col("depth") == F.col("length"), F.col("n")).alias("n"),
    )
    nodes = paths.groupBy("depth", "node", "letter").agg(F.max("n").alias("n")).groupBy("depth", "node").agg(
        F.array_sort(F.collect_set("letter")).alias("letters"), F.max("n").alias("n")
    )
    parents = nodes.select("depth", "node", F.explode("letters").alias("letter"), F.col("n").alias("node_n"))
    children = nodes.select(
        F.col("node").alias("child"), F.array_join("letters", "").alias("onward"), F.col("n").alias("child_n")
    )
    return parents.withColumn("child", F.concat("node", "letter")).join(children, "child")


def _reached(position: Column) -> Column:
    """The state at an edge's child with ``position`` letters used, or null if it could go no further."""
    ends = (position == F.col("length")) & F.col("child_n").isNotNull()
    goes_on = (position < F.col("length")) & F.col("onward").contains(F.substring("word", position + 1, F.lit(1)))
    state = F.struct(
        position.cast("int").alias("position"), F.col("child").alias("node"),
        F.when(position == F.col("length"), F.col("child_n")).alias("near_n"),
    )
    return F.when(ends | goes_on, state).cast(STATE)


def first_edits(unedited: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States with one edit, reached from words that follow their own path to this depth."""
    own = F.substring("word", F.lit(depth + 1), F.lit(1))
    replaced = F.when((F.col("length") > depth) & (F.col("letter") != own), _reached(F.lit(depth + 1)))
    inserted = _reached(F.lit(depth))
    skipped = F.when(
        (F.col("length") > depth + 1) & (F.col("letter") == F.substring("word", F.lit(depth + 2), F.lit(1))),
        _reached(F.lit(depth + 2)),
    )
    # The last letter left out: the node itself ends a word; the edge of that letter says so.
    without_last = F.when(
        (F.col("length") == depth + 1) & (F.col("letter") == own) & F.col("node_n").isNotNull(),
        F.struct(F.col("length").alias("position"), F.col("node"), F.col("node_n").alias("near_n")),
    ).cast(STATE)
    joined = unedited.withColumn("node", F.substring("word", F.lit(1), F.lit(depth))).join(edges, "node")
    return joined.select(
        "word", "length", F.explode(F.array_compact(F.array(replaced, inserted, skipped, without_last))).alias("state")
    ).select("word", "length", "state.*")


def next_letters(edited: DataFrame, edges: DataFrame) -> DataFrame:
    """States with their edit behind them, one letter on."""
    stepped = edited.withColumn("child", F.concat("node", F.substring("word", F.col("position") + 1, F.lit(1)))).drop("node")
    joined = stepped.join(edges.drop("node"), "child")
    return joined.select("word", "length", _reached(F.col("position") + 1).alias("state")).filter(
        F.col("state").isNotNull()
    ).select("word", "length", "state.*")


def plain(word: Column) -> Column:
    """The word behind a mark, in its own direction."""
    own = F.substring(word, F.lit(2), F.char_length(word))
    return F.when(word.startswith(FORWARDS), own).otherwise(F.reverse(own))


def trie_neighbours(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` of all pairs of words one edit apart; pairs may repeat."""
    ways = stored(both_ways(words), "spelling-ways")
    bounds = ways.agg(F.min("begin"), F.max("length")).first()
    found = words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    if bounds[0] is None:
        return found
    edges = stored(edge_table(ways, bounds[0]).repartitionByRange("depth", "node"), "spelling-edges")
    edited = None
    for depth in range(bounds[0], bounds[1] + 1):
        here = edges.filter(F.col("depth") == depth).drop("depth")
        unedited = ways.filter((F.col("begin") <= depth) & (F.col("length") >= depth)).select("word", "length")
        states = first_edits(unedited, here, depth)
        if edited is not None:
            states = states.unionByName(next_letters(edited.filter(F.col("position") < F.col("length")), here))
        edited = stored(states, "spelling-states")
        ended = edited.filter(F.col("near_n").isNotNull())
        found = found.unionByName(ended.select(plain(F.col("word")).alias("word"), plain(F.col("node")).alias("near"), "near_n"))
    return found


# A hash of letters in order: the value of a polynomial at a fixed place, modulo a prime.
_PRIME, _PLACE = 2**61 - 1, 1_000_003


def _hashes(word: str) -> tuple[int, list[int]]:
    """The hash of a word, and those of the word without its letter at each place."""
    tails, tail, power = [0], 0, 1
    for letter in reversed(word):
        tail = (ord(letter) * power + tail) % _PRIME
        power = power * _PLACE % _PRIME
        tails.append(tail)
    tails.reverse()
    # head: the letters before a place, as they stand when one letter fewer follows.
    shorter, head, power = [], 0, pow(_PLACE, len(word) - 2, _PRIME)
    down = pow(_PLACE, -1, _PRIME)
    for place, letter in enumerate(word):
        shorter.append((head + tails[place + 1]) % _PRIME)
        head = (head + ord(letter) * power) % _PRIME
        power = power * down % _PRIME
    return tails[0], shorter


def _cut_rows(batches):
    for batch in batches:
        for number, word in zip(batch["number"].to_pylist(), batch["word"].to_pylist()):
            whole, shorter = _hashes(word)
            places = list(range(-1, len(word)))
            for first in range(0, len(places), 65_536):
                part = places[first:first + 65_536]
                yield pa.RecordBatch.from_pydict({
                    "number": pa.array([number] * len(part), pa.int64()),
                    "length": pa.array([len(word) - (place >= 0) for place in part], pa.int64()),
                    "place": pa.array(part, pa.int64()),
                    "cut": pa.array([whole if place < 0 else shorter[place] for place in part], pa.int64()),
                })


def long_neighbours(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` as by the trie, for words of any length: equal but for one place left out."""
    numbered = stored(words.select(F.monotonically_increasing_id().alias("number"), "word", "n"), "spelling-long")
    cuts = stored(numbered.select("number", "word").mapInArrow(
        _cut_rows, "number bigint, length bigint, place bigint, cut bigint"
    ), "spelling-cuts")
    one = cuts.filter("place >= 0")
    other = one.select(F.col("number").alias("near"), "length", "place", "cut")
    # At most as many rows agree in place and rest as there are letters.
    replaced = one.join(other, ["length", "place", "cut"]).filter("number <> near").select("number", "near", "place")
    whole = cuts.filter("place < 0").select(F.col("number").alias("near"), "length", "cut")
    shorter = one.join(whole, ["length", "cut"]).select("number", "near", "place")
    left, right = (
        numbered.select(F.col("number").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
        for name in ("number", "near")
    )

    def without(word: str) -> Column:
        return F.concat(F.substring(word, F.lit(1), F.col("place").cast("int")), F.substring(word, F.col("place").cast("int") + 2, F.char_length(word)))

    replacing = replaced.join(left, "number").join(right, "near").filter(without("number_word") == without("near_word"))
    deleting = shorter.join(left, "number").join(right, "near").filter(without("number_word") == F.col("near_word"))
    return replacing.select(
        F.col("number_word").alias("word"), F.col("near_word").alias("near"), F.col("near_n")
    ).unionByName(deleting.select(
        F.explode(F.array(
            F.struct(F.col("number_word").alias("word"), F.col("near_word").alias("near"), F.col("near_n").alias("near_n")),
            F.struct(F.col("near_word").alias("word"), F.col("number_word").alias("near"), F.col("number_n").alias("near_n")),
        )).alias("pair")
    ).select("pair.*"))


def neighbours(words: DataFrame, trie_length: int = TRIE_LENGTH) -> DataFrame:
    """``(word, near, near_n)``: all pairs, in both orders, that differ by one letter inserted, deleted or replaced."""
    # Words of one more than the bound are in both parts, so pairs across it are found.
    short = words.filter(F.char_length("word") <= trie_length + 1)
    return trie_neighbours(short).unionByName(
        long_neighbours(words.filter(F.char_length("word") > trie_length))
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: forms followed to their end, twice as far each round.

    Each form is ``RATIO`` times as frequent as its word, so that no chain is long or closed.
    """
    ends = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = small(ends.select(F.col("word").alias("root"), F.col("root").alias("_further")))
        moved = stored(ends.join(onward, "root", "left"), "spelling-roots")
        if moved.filter("_further is not null").isEmpty():
            return ends
        ends = moved.select("word", F.coalesce("_further", "root").alias("root"))


def spelling_groups(
    documents: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    ratio: int = RATIO, trie_length: int = TRIE_LENGTH,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word: its neighbours, the most frequent of them if it is
    ``ratio`` times as frequent as the word, and the end of the chain of forms."""
    words = stored(dictionary(documents, noise, min_length, min_count), "spelling-words")
    best = neighbours(words, trie_length).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    common = -F.col("best.less") >= ratio * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    ), "spelling-forms")
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
