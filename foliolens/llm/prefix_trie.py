r"""Prefix trie of conversations, from ternary search trees over shards of their sorted turn sequences.

A turn is known by a digest of its role and text, a conversation by the string of its turns' digests.
Conversations with equal turns become one row.  The rows are range-partitioned and sorted, so that a
shard is a run of neighbours.  In a shard turns become small codes, and its sequences, the median
first, are inserted in a ternary search tree; a traversal without recursion adds up members, leaves
and savings.  Only the paths of a shard's first and last sequence can go on in other shards.  They
are merged in order, first in the task that reads the shards, then over groups of tasks, until one
group is left; what a task holds is bounded by a shard and the longest conversation.

Defined cases: a null role or text is empty; a null turn comes first, and equal turns are ordered by
role and by the SHA-256 of the text; repeated rows are turns of their own; rows without ``conv_id`` are
one conversation that keeps its own turns, counts as a member, is never the smallest of several and
is left out of the lists of ids; the base of a negative id is the next multiple towards 0; an empty
table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import small, stored
from foliolens.llm.mixing import word_count

# Turns in a ternary search tree, and summaries merged by a task.
SHARD_TURNS = 50_000
MERGED = 256
# A rebuilt conversation begins as the first one of its so many.
FAMILY = 20
SHARED_TURNS = 4

DIGEST = 16
_PATH = "array<struct<key:binary,depth:int,words:bigint,n_convs:bigint,conv_id:bigint,n_children:bigint,n_leaves:bigint,saved:bigint,ends:string>>"
SCHEMA = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    f"n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, part bigint, left {_PATH}, right {_PATH}"
)
_NODE = pa.struct([
    ("key", pa.binary()), ("depth", pa.int32()), ("words", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])
_TYPES = {
    "key": pa.binary(), "parent_key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(),
    "part": pa.int64(), "left": pa.list_(_NODE), "right": pa.list_(_NODE),
}


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, digests, words)`` of each conversation: its turns' digests end to end, and their word counts."""
    text, role = (F.coalesce(F.col(name), F.lit("")) for name in ("text", "role"))
    # Texts are hashed before they would be shuffled.
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("text"), word_count(text).alias("words")
    )
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "words"))).alias("said"))
    digest = F.transform("said", lambda t: F.substring(F.sha2(F.concat(t["text"], t["role"]).cast("binary"), 256), 1, 2 * DIGEST))
    return said.select(
        "conv_id", F.unhex(F.array_join(digest, "")).alias("digests"), F.transform("said", lambda t: t["words"]).alias("words")
    )


def rebuilt(own: DataFrame, family: int = FAMILY, shared: int = SHARED_TURNS) -> DataFrame:
    """Each conversation behind the first turns of its family's first, in place of as many of its own."""
    bases = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.substring("digests", 1, DIGEST * (shared - 1)).alias("base_digests"),
        F.slice("words", 1, shared - 1).alias("base_words"),
    )
    taken = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)), F.lit(0)).cast("int")
    joined = own.withColumn("taken", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(bases, "base", "left")
    return joined.select(
        "conv_id",
        F.concat(
            F.coalesce(F.substring("base_digests", F.lit(1), DIGEST * F.col("taken")), F.lit(b"")),
            F.substring("digests", DIGEST * F.col("taken") + 1, F.octet_length("digests")),
        ).alias("digests"),
        F.concat(
            F.coalesce(F.slice("base_words", F.lit(1), F.col("taken")), F.array().cast("array<bigint>")),
            F.slice("words", F.col("taken") + 1, F.size("words")),
        ).alias("words"),
    )


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """``(digests, bucket, words, n, least, ids)``: equal conversations as one row for each range of ids.

    ``ids`` has the range's ids, ascending and joined by commas, so that the members of a large
    group of copies are gathered by many tasks.
    """
    ranged = conversations.repartitionByRange("conv_id").withColumn("bucket", F.spark_partition_id())
    return ranged.groupBy("digests", "bucket").agg(
        F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
    )


@dataclass
class Node:
    """A node on the edge of a shard; sums are without its child on that edge."""

    key: bytes
    depth: int
    words: int
    n_convs: int = 0
    conv_id: int | None = None
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def add(self, other: Node) -> None:
        self.n_convs += other.n_convs
        self.conv_id = least(self.conv_id, other.conv_id)
        self.n_children += other.n_children
        self.n_leaves += other.n_leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def path_keys(digests: list[bytes]) -> list[bytes]:
    """A digest of every prefix, the empty one first."""
    keys = [b""]
    for digest in digests:
        keys.append(hashlib.blake2b(keys[-1] + digest, digest_size=DIGEST).digest())
    return keys


class Tree:
    """A ternary search tree of code sequences.  Node 0 is the empty sequence; links to 0 lead nowhere."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.first, self.parent = [-1], [0], [0], [0], [0]
        self.words, self.n_convs, self.conv_id, self.ends = [0], [0], [None], [None]

    def _new(self, parent: int, code: int, words: int) -> int:
        for values, value in (
            (self.code, code), (self.low, 0), (self.high, 0), (self.first, 0), (self.parent, parent),
            (self.words, words), (self.n_convs, 0), (self.conv_id, None), (self.ends, None),
        ):
            values.append(value)
        return len(self.code) - 1

    def _child(self, parent: int, code: int, words: int) -> int:
        at, links = self.first[parent], self.first
        place = parent
        while at:
            if code == self.code[at]:
                return at
            place, links = at, self.low if code < self.code[at] else self.high
            at = links[at]
        links[place] = self._new(parent, code, words)
        return links[place]

    def insert(self, codes: list[int], words: list[int]) -> int:
        node = 0
        for code, count in zip(codes, words):
            node = self._child(node, code, count)
        return node

    def path(self, node: int) -> list[int]:
        found = [node]
        while node:
            node = self.parent[node]
            found.append(node)
        return found[::-1]

    def order(self) -> list[int]:
        """All nodes, parents before children."""
        found, waiting = [0], [self.first[0]]
        while waiting:
            node = waiting.pop()
            if node:
                found.append(node)
                waiting += [self.high[node], self.low[node], self.first[node]]
        return found


Sequence = tuple[bytes, list[int], int, "int | None", str]


def medians(count: int) -> Iterator[int]:
    """0 to ``count`` - 1, the middle of every range before its halves."""
    waiting = [(0, count)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


def shard_tree(sequences_: list[Sequence], rows: list[dict]) -> tuple[list[Node], list[Node]]:
    """The paths of the first and of the last of a shard's sorted sequences; rows of all other nodes are added."""
    turns = [[s[0][i:i + DIGEST] for i in range(0, len(s[0]), DIGEST)] for s in sequences_]
    codes = {digest: code for code, digest in enumerate(sorted({d for own in turns for d in own}))}
    tree, last = Tree(), [0] * len(turns)
    for place in medians(len(turns)):
        _, words, n, conv_id, ends = sequences_[place]
        node = last[place] = tree.insert([codes[d] for d in turns[place]], words)
        tree.n_convs[node], tree.conv_id[node], tree.ends[node] = n, conv_id, ends
    edge: dict[int, Node] = {}
    sides = []
    for place in (0, -1):
        path = list(zip(tree.path(last[place]), path_keys(turns[place])))
        sides.append([edge.setdefault(node, Node(key, depth, tree.words[node])) for depth, (node, key) in enumerate(path)])
    order = tree.order()
    size = len(tree.code)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        parent = tree.parent[node]
        if node:
            tree.n_convs[parent] += tree.n_convs[node]
            tree.conv_id[parent] = least(tree.conv_id[parent], tree.conv_id[node])
        if node in edge:
            own = edge[node]
            own.n_convs, own.conv_id, own.ends = tree.n_convs[node], tree.conv_id[node], tree.ends[node]
            own.n_children, own.n_leaves, own.saved = children[node], leaves[node], saved[node]
            continue
        leaves[node] = leaves[node] or 1
        saved[node] += (tree.n_convs[node] - 1) * tree.words[node]
        children[parent] += 1
        leaves[parent] += leaves[node]
        saved[parent] += saved[node]
    depth = [0] * size
    for node in order[1:]:
        parent = tree.parent[node]
        depth[node] = depth[parent] + 1
        if node not in edge:
            rows.append({
                "parent_key": edge[parent].key if parent in edge else None, "conv_id": tree.conv_id[node], "depth": depth[node],
                "parent_conv_id": None if parent in edge else tree.conv_id[parent], "n_convs": tree.n_convs[node],
                "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node], "ends": tree.ends[node],
            })
    return sides[0], sides[1]


@dataclass
class Merger:
    """Joins the edges of neighbouring shards, in order.  Nodes that no later shard can hold become rows,
    but for those of the first path, which earlier ones may hold, unless there is nothing ``before``."""

    rows: list[dict]
    before: bool = True
    path: list[Node] = field(default_factory=list)
    left: list[Node] = field(default_factory=list)
    # So many nodes of the path are also on the first path.
    first: int | None = None

    def add(self, left: list[Node], right: list[Node]) -> None:
        if self.first is None:
            self.first = len(left) if self.before else 0
        self._append(left)
        shared = _shared(left, right)
        self._close(shared)
        self.path += right[shared:]

    def _append(self, other: list[Node]) -> None:
        shared = _shared(self.path, other)
        self._close(shared)
        for own, more in zip(self.path, other):
            own.add(more)
        self.path += other[shared:]

    def _close(self, size: int) -> None:
        while len(self.path) > size:
            node = self.path.pop()
            if len(self.path) < self.first:
                self.first = len(self.path)
                self.left.append(node)
            else:
                self._finish(node)

    def _finish(self, node: Node) -> None:
        node.n_leaves = node.n_leaves or 1
        node.saved += (node.n_convs - 1) * node.words
        parent = self.path[-1] if self.path else None
        self.rows.append({
            "key": node.key, "parent_key": parent.key if parent else None, "conv_id": node.conv_id, "depth": node.depth,
            "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved,
            "ends": node.ends,
        })
        if parent:
            parent.n_children += 1
            parent.n_leaves += node.n_leaves
            parent.saved += node.saved

    def end(self, part: int) -> None:
        """A row with the edges of all that was added; with nothing before it, rows of all that is left."""
        if not self.before:
            self._close(0)
        elif self.first is not None:
            left = self.path[:self.first] + self.left[::-1]
            # The nodes of both paths are written with the left one; on the right only their keys count.
            both = [Node(node.key, node.depth, node.words) for node in self.path[:self.first]]
            self.rows.append({
                "part": part, "left": [vars(node) for node in left], "right": [vars(node) for node in both + self.path[self.first:]],
            })


def _shared(a: list[Node], b: list[Node]) -> int:
    count = 0
    while count < min(len(a), len(b)) and a[count].key == b[count].key:
        count += 1
    return count


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(rows), 10_000):
        part = rows[first:first + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row.get(name) for row in part], kind) for name, kind in _TYPES.items()], names=list(_TYPES)
        )
    rows.clear()


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[Sequence]:
    """Rows of one sequence as one, with the hash of all their ids."""
    held, seen = None, None
    for batch in batches:
        for digests, words, n, first, ids in zip(*(batch[name].to_pylist() for name in ("digests", "words", "n", "least", "ids"))):
            if held is None or held[0] != digests:
                if held is not None:
                    yield (*held, seen.hexdigest())
                held, seen, separator = [digests, words, 0, None], hashlib.sha256(), b""
            held[2] += n
            held[3] = least(held[3], first)
            if ids:
                seen.update(separator + ids.encode())
                separator = b","
    if held is not None:
        yield (*held, seen.hexdigest())


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    merger, shard, turns = Merger(rows), [], 0
    for sequence in _folded(batches):
        shard.append(sequence)
        turns += len(sequence[0]) // DIGEST + 1
        if turns >= SHARD_TURNS:
            merger.add(*shard_tree(shard, rows))
            yield from _batches(rows)
            shard, turns = [], 0
    if shard:
        merger.add(*shard_tree(shard, rows))
    merger.end(TaskContext.get().partitionId())
    yield from _batches(rows)


def _merged(before: bool):
    def merge(table: pa.Table) -> pa.Table:
        rows: list[dict] = []
        merger, group = Merger(rows, before), 0
        for summary in table.sort_by("part").to_pylist():
            merger.add(*([Node(**node) for node in summary[side]] for side in ("left", "right")))
            group = summary["part"] // MERGED
        merger.end(group)
        found = list(_batches(rows))
        return pa.Table.from_batches(found, schema=pa.schema(list(_TYPES.items())))

    return merge


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED_TURNS) -> DataFrame:
    """A row for each distinct beginning of rebuilt conversations, the empty one first: ``(conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    own = stored(sequences(conversations), "trie-sequences")
    return trie_nodes(stored(rebuilt(own, family, shared), "trie-rebuilt"))


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The trie of rows ``(conv_id, digests, words)``."""
    distinct = stored(distinct_sequences(conversations), "trie-distinct")
    ordered = distinct.repartitionByRange("digests").sortWithinPartitions("digests", "bucket")
    level = stored(ordered.mapInArrow(_shards, SCHEMA), "trie-nodes")
    nodes = level.filter("part is null")
    summaries = level.filter("part is not null").select("part", "left", "right")
    top = summaries.agg(F.max("part")).first()[0]
    while top is not None:
        last = top < MERGED
        level = stored(
            summaries.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInArrow(_merged(not last), SCHEMA), "trie-nodes"
        )
        nodes = nodes.unionByName(level.filter("part is null"))
        summaries = level.filter("part is not null").select("part", "left", "right")
        top = None if last else top // MERGED
    known = small(nodes.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(known, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )
