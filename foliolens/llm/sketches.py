r"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the
smallest hash in any case, so that a text with a shingle has a sketch.  Two sketches hold
the same share of what their texts share, whatever the texts' lengths: the part of the
smaller sketch found in the larger one estimates how much of the smaller text the larger
contains.  Sketches of parts merge into the sketch of the whole.

Shingles: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, five in a row (fewer: all of them).  A
sketch is written as its hashes in order, 16 hexadecimal digits each.

Defined cases: a null text counts as empty; a text without words has the empty sketch,
like another empty one (1.0) and no other (0.0); equal texts have equal sketches; rows with
equal ids stand in the order of their texts, a null id before all others; after the last
row comes the first, so a single row is its own next; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import shingle_digests

SHINGLE_WORDS = 5
# One in so many hashes is kept.
SCALE = 8
# Documents in one range of ids, and ranges, at most.
RANGE_ROWS = 4096
MAX_RANGES = 65536


def hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> np.ndarray:
    """The kept hashes, sorted."""
    found = shingle_digests(text, shingle_words, xxhash.xxh3_64_digest)
    if not len(found):
        return found
    kept = found[found < np.uint64((1 << 64) // scale)]
    return np.unique(kept if len(kept) else found.min(keepdims=True))


def written(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of all shingles of both; a hash above the threshold stays only if it is the one left."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64((1 << 64) // scale)]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    @F.arrow_udf("string")
    def sketches(texts: pa.Array) -> pa.Array:
        return pa.array([written(hashes(value.as_py(), shingle_words, scale)) for value in texts], pa.string())

    return sketches(text)


def likeness(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def shares(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([containment(read(x.as_py()), read(y.as_py())) for x, y in zip(left, right)], pa.float64())

    return shares(a, b)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(documents: DataFrame) -> DataFrame:
    """``(bucket, halo, doc_id, text)``: documents by range of ids, sorted in each.

    The documents with the first id of a range also go, as ``halo``, to the range before it,
    whose last document they follow; those of the first range go to the last.
    """
    ids = documents.select("doc_id")
    ranges = max(1, min(MAX_RANGES, ids.count() // RANGE_ROWS))
    cuts = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    def numbers(values: pa.Array) -> pa.Array:
        known = np.searchsorted(bounds, values.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1
        return pa.array(np.where(values.is_null().to_numpy(zero_copy_only=False), 0, known), pa.int32())

    keyed = ids.select(F.arrow_udf(numbers, "int")("doc_id").alias("bucket"), "doc_id")
    # One row per range: bounded by MAX_RANGES.
    firsts = sorted(tuple(row) for row in keyed.groupBy("bucket").agg(F.min("doc_id")).collect())
    before = {number: firsts[i - 1][0] for i, (number, _) in enumerate(firsts)}
    first_id = {number: first for number, first in firsts}

    @F.arrow_udf("array<struct<bucket:int,halo:boolean>>")
    def places(values: pa.Array) -> pa.Array:
        own = numbers(values).to_pylist()
        return pa.array(
            [
                [{"bucket": number, "halo": False}]
                + ([{"bucket": before[number], "halo": True}] if value == first_id[number] else [])
                for number, value in zip(own, values.to_pylist())
            ],
            pa.list_(pa.struct([("bucket", pa.int32()), ("halo", pa.bool_())])),
        )

    placed = documents.select("doc_id", "text", F.explode(places("doc_id")).alias("_place"))
    return placed.select("_place.bucket", "_place.halo", "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(
        max(ranges, 1), "bucket"
    ).sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")


def with_next(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness to it and to the next document's."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = None, None
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                number, halo, doc_id, text = row
                if number != bucket:
                    held, bucket = None, number
                elif held is None:
                    continue
                own = hashes(text, shingle_words, scale)
                if held is not None:
                    last_id, last, kept = held
                    changed = edited(last, text)
                    other = hashes(changed, shingle_words, scale)
                    out.append((
                        last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), written(kept),
                        written(other), containment(kept, other), containment(kept, own),
                    ))
                held = None if halo else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)], names=names
                )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_ranges(documents).mapInArrow(compare, schema)
