"""Spelling groups against plain loops over the whole small tables, and on odd words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliolens.llm import spelling
from foliolens.llm.queries import QUERIES

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(LETTERS.upper(), LETTERS)


def brute_dictionary(texts, noise=199):
    counts = Counter()
    for doc_id, text in texts:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWERED)
            drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if drawn % noise == 0:
                word = word[: drawn % len(word)] + word[drawn % len(word) + 1:]
            counts[word] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def brute_near(words):
    """Words that agree once a letter is left out, then compared letter by letter."""
    held = {}
    for word in words:
        for cut in {word, *(word[:i] + word[i + 1:] for i in range(len(word)))}:
            held.setdefault(cut, set()).add(word)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))

    near = {word: set() for word in words}
    for group in held.values():
        for a in group:
            near[a].update(b for b in group if b not in near[a] and one_edit(a, b))
    return near


def brute_groups(words):
    near, form = brute_near(words), {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-words[other], other), default=None)
        form[word] = best if best is not None and words[best] >= 5 * words[word] else None
    rows = set()
    for word in words:
        root = word
        while form[root] is not None:
            root = form[root]
        rows.add((word, form[word], root, words[word], len(near[word]), words.get(form[word])))
    return rows


def test_whole_table(spark, sf_dir, texts):
    wanted = brute_groups(brute_dictionary([text[:2] for text in texts]))
    rows = QUERIES["op11_spelling"](spark, sf_dir)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(row) for row in rows.collect()} == wanted
    assert any(row[1] != row[2] for row in wanted if row[1]) or any(row[1] for row in wanted)


def made_words(seed=2):
    random = np.random.default_rng(seed)
    words = set()
    for _ in range(150):
        word = "".join(random.choice(list("abé"), random.integers(6, 14)))
        words.add(word)
        for _ in range(4):
            place = int(random.integers(0, len(word) + 1))
            word = (word[:place] + random.choice(list("abéz")) + word[place + int(random.integers(0, 2)):],
                    word[:place] + word[place + 1:])[int(random.integers(0, 2))]
            words.add(word)
    return {word: int(random.integers(5, 400)) for word in sorted(words) if len(word) >= 6}


@pytest.mark.parametrize("bound", [4, 9, 40])
def test_trie_and_long_words_find_the_same_pairs(spark, bound):
    words = made_words()
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = [tuple(row) for row in spelling.neighbours(frame, bound).collect()]
    wanted = {(word, other, words[other]) for word, others in brute_near(words).items() for other in others}
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_very_long_words(spark):
    long = "ab" * 20_000
    words = {long: 5, long[:30_000] + "z" + long[30_001:]: 50, long[:100] + long[101:]: 9, long[:-1]: 8, long + "ba": 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = {(row.word, row.near) for row in spelling.neighbours(frame).collect()}
    a, b, c, d, _ = words
    assert found == {(a, b), (b, a), (a, c), (c, a), (a, d), (d, a)}


def test_chains_lead_to_their_end(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(25)] + [("x", "y")]
    rows = {tuple(row) for row in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert rows == {(f"w{i:03}", "w025") for i in range(25)} | {("x", "y")}


def test_odd_rows(spark, odd, none):
    texts = [(1, "Kitten kitten KITTEN kitten, kitten; sittén×ab") for _ in range(2)] + [(None, "mitten " * 50), (2, None), (3, "")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    wanted = brute_groups(brute_dictionary(texts))
    rows = spelling.spelling_groups(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(row) for row in rows} == wanted and ("kitten", "mitten", "mitten", 10, 1, 50) in wanted
    assert spelling.spelling_groups(none).count() == 0
    assert spelling.spelling_groups(odd, min_length=5).count() > 0
