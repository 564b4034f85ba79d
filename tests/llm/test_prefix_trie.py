"""The prefix trie against plain loops, over small and large shards and groups of them."""

import hashlib
import zlib

import numpy as np
import pytest

from foliolens.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Nodes of the conversations as they are rebuilt, by dictionaries of prefixes."""
    own = {}
    for conv_id, turn, role, text in rows:
        own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {conv_id: [(t[2], t[4]) for t in sorted(turns)] for conv_id, turns in own.items()}
    whole = {}
    for conv_id, turns in own.items():
        h = 0 if conv_id is None else zlib.crc32(str(conv_id).encode()) % 4
        whole[conv_id] = own.get(conv_id - conv_id % 20, [])[:h] + turns[h:] if h else turns
    members = {}
    for conv_id, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv_id)
    names = {node: min((c for c in ids if c is not None), default=None) for node, ids in members.items()}
    found = []
    for node, ids in members.items():
        below = [other for other in members if other[:len(node)] == node]
        ends = sorted(c for c in ids if c is not None and len(whole[c]) == len(node))
        found.append((
            names[node], len(node), names[node[:-1]] if node else None, len(ids),
            sum(len(other) == len(node) + 1 for other in below),
            sum(not any(more[:-1] == other for more in members if more) for other in below),
            sum((len(members[other]) - 1) * len(other[-1][1].split()) for other in below if other),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def made_rows(count, seed=4):
    random = np.random.default_rng(seed)
    rows = []
    for conv_id in random.permutation(count).tolist():
        for turn in range(int(random.integers(1, 7))):
            rows.append((conv_id, turn, ["user", "assistant"][turn % 2], "w " * int(random.integers(1, 3))))
    # Copies of one conversation, and one that is much longer than all others.
    for conv_id in range(count + 20, count + 60):
        rows += [(conv_id, turn, "user", "the same words") for turn in range(5)]
    rows += [(count + 101, turn, "user", "the same words") for turn in range(300)]
    return rows


def nodes(frame):
    return sorted((tuple(row) for row in prefix_trie.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("turns, merged, parts", [(50_000, 256, 3), (30, 2, 8), (1, 3, 8), (200, 256, 1)])
def test_shards_and_merges(spark, monkeypatch, turns, merged, parts):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "MERGED", merged)
    rows = made_rows(120)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    # Workers read the size from the module, so the patched one is sent with the function.
    monkeypatch.setattr(prefix_trie, "_shards", small_shards(turns))
    try:
        assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def small_shards(turns):
    own = prefix_trie._shards

    def run(batches):
        from foliolens.llm import prefix_trie as there

        there.SHARD_TURNS = turns
        yield from own(batches)

    return run


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, None, None, "first"), (2, 1, "user", None), (2, 1, "assistant", None),
        (None, 0, "user", "a b"), (None, 1, "user", "c"), (40, 0, "user", "a b"), (41, 5, None, ""), (42, 0, None, None),
        (43, 0, "", "x " * 40_000), (2**62 + 3, 0, "user", "a b"), (60, 0, "us", "era b"), (61, 0, "us", "era b"),
    ]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert nodes(spark.createDataFrame([(None, 1, "user", "c")], SCHEMA)) == brute([(None, 1, "user", "c")])


def test_no_rows(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_columns_that_are_not_read(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    wide = spark.createDataFrame([(*row, "x", "y", 1) for row in rows], SCHEMA + ", digests string, words string, part int")
    assert nodes(wide) == brute(rows)


def test_trees_are_balanced():
    tree = prefix_trie.Tree()
    for code in prefix_trie.medians(1000):
        tree.insert([code], [1])
    deepest = [0] * 1001
    for node in range(1, 1001):
        for below in (tree.low[node], tree.high[node]):
            deepest[below] = deepest[node] + 1 if below else deepest[0]
    assert sorted(tree.code[1:]) == list(range(1000)) and max(deepest) < 10
