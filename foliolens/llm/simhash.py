r"""SimHash near-duplicates, found with BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree in whole blocks: cut into
``b`` blocks, in at least ``b - radius`` of them.  Every choice of that many blocks routes a
fingerprint to the shard of its bits there, so two linked fingerprints meet in a shard.
A shard's fingerprints form a BK-tree, whose children are keyed by their Hamming distance
to the parent, and each fingerprint follows only edges within the radius of its own
distance.  The number of blocks grows with the corpus, so shards stay small.  All trees
together grow with the corpus as well; each is therefore sent to the tasks that hold its
shard's queries, not to every executor.  A shard over ``CELL_ROWS`` is cut into trees of
bounded size, each searched by each bounded part of the shard's fingerprints.

Only distinct fingerprints are searched, and a shard returns a spanning star for each group
it finds, never all pairs.  Stars are then joined into components.

A fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of four words (fewer: all
of them) joined by spaces, XXH64 (seed 42) of each; a bit is 1 if set in over half of them.

Defined cases: a null, empty or blank text has fingerprint 0, linked like any other; a
group's id is its smallest doc_id, null only if all are null; rows with equal ids and texts
are one document for deduplication; very long texts are handled whole; empty tables give
empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliolens.llm.common import shingle_digests, stored, whole_rows

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
# Fingerprints of a shard on average, and in one tree, at most.
SHARD_ROWS = 128
CELL_ROWS = 8192
# Pairs of a query and a tree node looked at together.
_FRONTIER = 2_000_000


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = shingle_digests(text, shingle_words, lambda shingle: xxhash.xxh64_digest(shingle, SEED))
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for first in range(0, len(octets), 65536):
        votes += np.unpackbits(octets[first:first + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(octets)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(value.as_py(), shingle_words) for value in texts], pa.int64())

    return fingerprints(text)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def choose_blocks(fingerprints: int, radius: int) -> list[list[tuple[int, int]]]:
    """The shards' keys: each a list of ``(first bit, bits)``, enough bits for shards of bounded average size."""
    for blocks in range(radius + 1, 65):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        chosen = blocks - radius
        if 2 ** (chosen * (64 // blocks)) * SHARD_ROWS >= fingerprints or comb(blocks, chosen) > 100:
            break
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in choice] for choice in combinations(range(blocks), chosen)]


def shard_key(value: Column, parts: list[tuple[int, int]]) -> Column:
    key = F.lit(0).cast("bigint")
    for first, bits in parts:
        part = F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        key = F.shiftleft(key, bits).bitwiseOR(part)
    return key


class Trees:
    """BK-trees of many groups at once; ``group`` is sorted, fingerprints of a group are distinct."""

    def __init__(self, fingerprints: np.ndarray, group: np.ndarray):
        self.values = fingerprints
        roots = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = dict(zip(group[roots].tolist(), roots.tolist()))
        anchor = roots[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        placed = np.zeros(len(group), bool)
        placed[roots] = True
        children, edges = [], []
        while not placed.all():
            open_ = np.flatnonzero(~placed)
            at = anchor[open_]
            distance = np.bitwise_count(self.values[open_] ^ self.values[at]).astype(np.int64)
            # The first at each distance becomes the child, and the rest go on below it.
            keys, first, member = np.unique(at * 65 + distance, return_index=True, return_inverse=True)
            child = open_[first]
            children.append(child)
            edges.append(keys)
            placed[child] = True
            anchor[open_] = child[member]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges = self.edges[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def search(self, values: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most ``radius`` apart."""
        query, node = np.arange(len(values)), roots
        while len(query):
            distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
            fan = high - low
            query = np.repeat(query, fan)
            node = self.children[np.repeat(low - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; a label points to a smaller member of its set, at last to the smallest."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(left[apart], right[apart]), np.minimum(left[apart], right[apart]))
        while (label != label[label]).any():
            label[:] = label[label]


def shard_stars(cell: np.ndarray, value: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprint, centre)`` for every linked fingerprint of the cells that is not a centre.

    ``side`` has bit 1 for members of the cell's tree and bit 2 for its queries.
    """
    order = np.argsort(cell, kind="stable")
    cell, value, side = cell[order], value[order], side[order]
    label = np.arange(len(cell))
    member = np.flatnonzero(side & 1)
    asking = np.flatnonzero(side & 2)
    if len(member) and len(asking):
        trees = Trees(value[member], cell[member])
        roots = np.array([trees.root.get(c, -1) for c in cell[asking].tolist()], dtype=np.int64)
        asking, roots = asking[roots >= 0], roots[roots >= 0]
        sizes = np.bincount(np.searchsorted(np.unique(cell), cell))[np.searchsorted(np.unique(cell), cell[asking])]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _FRONTIER)) + 1
        for part in np.split(np.arange(len(asking)), cuts):
            own = asking[part]
            for query, node in trees.search(value[own], roots[part], radius):
                _join(label, own[query], member[node])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return value[linked], value[label[linked]]


def links(fingerprints: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Stars ``(a, b)`` that connect all of the distinct ``fp`` that are linked."""
    keys = choose_blocks(count, radius)
    routed = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), shard_key(F.col("fp"), parts).alias("bits"))
        for i, parts in enumerate(keys)
    ])).alias("shard")).select("fp", F.xxhash64("shard.choice", "shard.bits").alias("shard"))
    # Shards over the bound: few, as each takes many fingerprints.
    large = routed.groupBy("shard").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > CELL_ROWS).select(
        F.col("shard").alias("_large"), F.ceil(F.col("_rows") / CELL_ROWS).cast("int").alias("_parts")
    )
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = routed.join(large, F.col("shard") == F.col("_large"), "left").select(
        "fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    ).select(
        "fp",
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            values = table["fp"].to_numpy().view(np.uint64)
            a, b = shard_stars(table["cell"].to_numpy(), values, table["side"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "a bigint, b bigint")


def _whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Sorted batches put together into tables of about ``rows`` rows that do not cut a cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            table = pa.Table.from_batches(held)
            cell = table["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge, root being the smallest of its component.

    Large and small stars in turn: each round hangs a node's larger, then its smaller,
    neighbours on its smallest one, until all components are stars.
    """
    pairs = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    ).distinct().checkpoint()
    seen = None
    while True:
        both = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).union(pairs.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("_least"))
        large = both.join(least, "u").filter("v > u").select(
            F.col("v").alias("high"), F.least("u", "_least").alias("low")
        ).distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("_least"))
        small = large.join(smallest, "high").filter("low <> _least").select(
            F.col("low").alias("high"), F.col("_least").alias("low")
        )
        pairs = small.union(smallest).distinct().checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if now == seen:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = now


def groups(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root, keeper)`` for ``(fp, doc_id)`` rows: the smallest fingerprint and doc_id of each one's component.

    Only ``root`` tells components apart: ids can be null, or stand on texts that are not linked.
    """
    distinct = stored(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp"), distinct.count(), radius))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("keeper"))
    return named.select("fp", "root").join(least, "root").select("fp", "root", "keeper")


def components(
    documents: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every input row."""
    prints = stored(
        documents.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")), "fingerprints"
    )
    named = groups(prints, radius)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("keeper").alias("component_id"))


def deduplicated(documents: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns.

    If rows of the component share that id, the one with the smallest text hash stays.
    """
    prints = stored(
        documents.select(
            "doc_id", F.xxhash64("text").alias("text_key"), fingerprint(F.col("text"), shingle_words).alias("fp")
        ),
        "fingerprints",
    )
    named = groups(prints.select("fp", "doc_id"), radius)
    kept = prints.join(named, "fp").groupBy("root", "keeper").agg(
        F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_text_key")
    ).select(F.col("keeper").alias("_doc_id"), "_text_key")
    rows = whole_rows(documents, doc_id=F.col("doc_id"), text_key=F.xxhash64("text")).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    )
    copy = Window.partitionBy("doc_id", "text_key").orderBy(F.lit(0))
    return rows.withColumn("_copy", F.row_number().over(copy)).filter("_copy = 1").select("row.*")
