r"""Removing lines that repeat across documents, with two Bloom filters.

One filter holds the hashes of keys seen once, the other those seen again.  Each task
fills its own pair, pairs are merged slice by slice (seen again: in either second filter,
or in both first ones), and only lines that the merged second filter suspects are
shuffled: their keys are counted exactly, and each repeated key stays in one document.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends, A-Z lower-cased.  A key
counts once per document.  Keys of at least ``min_chars`` code points found in at least
``min_documents`` documents lose all their lines, except in the largest doc_id holding
it.

The filters have a fixed size, chosen from the corpus size and bounded by ``MAX_BYTES``.
A filter that is too full suspects more lines; results stay exact.

Defined cases: a null or empty text is one empty line (a null text stays null); rows with
the same doc_id count as one document, and a null doc_id as a document before all others;
very long texts are handled whole; a document may lose all its lines and is then empty;
empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored, whole_rows

MIN_CHARS = 20
MIN_DOCUMENTS = 3
# Filter bits for each byte of text (about ten for a line), and bytes of one filter at most.
BITS_PER_BYTE = 0.06
MAX_BYTES = 128 * 1024 * 1024
# A slice is the unit in which filters are merged; a hash lies in one 64-bit word of it.
SLICE_WORDS = 16 * 1024
_BITS = 4
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or nothing if it is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE).lower()
    return key if len(key.translate(None, _CONTINUATION)) >= min_chars else None


def text_keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n")}
    keys.discard(None)
    return keys


def filter_words(text_bytes: int) -> int:
    """64-bit words of a filter: a power of two, at least one slice."""
    wanted = min(text_bytes * BITS_PER_BYTE / 64, MAX_BYTES / 8)
    return max(SLICE_WORDS, 1 << (max(1, int(wanted)) - 1).bit_length())


class Filter:
    """Two blocked Bloom filters over 64-bit hashes: a hash sets four bits of one word."""

    def __init__(self, words: int):
        self.once, self.again = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    @staticmethod
    def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.zeros(len(hashes), np.uint64)
        for i in range(_BITS):
            bits |= np.uint64(1) << ((hashes >> np.uint64(6 * i)) & np.uint64(63))
        return ((hashes >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64), bits

    def add(self, hashes: np.ndarray) -> None:
        distinct, counts = np.unique(hashes, return_counts=True)
        word, bits = self.places(distinct, len(self.once))
        seen = (counts > 1) | ((self.once[word] & bits) == bits)
        np.bitwise_or.at(self.again, word[seen], bits[seen])
        np.bitwise_or.at(self.once, word, bits)


def _hashes(texts: pa.Array, min_chars: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array(
        [digest(key) for text in texts for key in text_keys(text.as_py(), min_chars)], dtype=np.uint64
    )


def repeated_filter(documents: DataFrame, min_chars: int) -> tuple[int, DataFrame]:
    """The filter's words, and the merged second filter as rows ``(slice, bits)``; slices without bits are left out."""
    size = documents.select(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    words = filter_words(size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(words)
        for batch in batches:
            own.add(_hashes(batch.column(0), min_chars))
        pack = zstandard.ZstdCompressor(level=1)
        for start in range(0, words, SLICE_WORDS):
            once = own.once[start:start + SLICE_WORDS]
            if once.any():
                again = own.again[start:start + SLICE_WORDS]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([start // SLICE_WORDS], pa.int32()),
                    "bits": [pack.compress(once.tobytes() + again.tobytes())],
                })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                once, again = np.frombuffer(unpack.decompress(bits.as_py()), np.uint64).reshape(2, -1)
                if number in merged:
                    first, second = merged[number]
                    second |= again | (first & once)
                    first |= once
                else:
                    merged[number] = (once.copy(), again.copy())
        for number, (_, again) in merged.items():
            if again.any():
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([number], pa.int32()), "bits": [pack.compress(again.tobytes())]
                })

    schema = "slice int, bits binary"
    slices = max(1, words // SLICE_WORDS)
    parts = documents.select("text").mapInArrow(fill, schema)
    return words, parts.repartition(min(slices, 64), "slice").mapInArrow(merge, schema)


def suspected_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """``(key, doc_id)`` of the lines whose hash the second filter holds, once per row."""
    spark = documents.sparkSession
    words, slices = repeated_filter(documents, min_chars)
    # At most MAX_BYTES: the filter's size does not follow the corpus beyond that.
    held = spark.sparkContext.broadcast([(row["slice"], bytes(row["bits"])) for row in slices.toLocalIterator()])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, unpack = np.zeros(words, np.uint64), zstandard.ZstdDecompressor()
        for number, bits in held.value:
            again[number * SLICE_WORDS:(number + 1) * SLICE_WORDS] = np.frombuffer(unpack.decompress(bits), np.uint64)
        for batch in batches:
            keys, owners = [], []
            for owner, text in enumerate(batch.column(1)):
                own = text_keys(text.as_py(), min_chars)
                keys.extend(own)
                owners.extend([owner] * len(own))
            word, bits = Filter.places(
                np.array([xxhash.xxh3_64_intdigest(key) for key in keys], dtype=np.uint64), words
            )
            chosen = np.flatnonzero((again[word] & bits) == bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i].decode() for i in chosen], pa.string()),
                    batch.column(0).take(pa.array(np.array(owners, dtype=np.int64)[chosen])),
                ],
                names=["key", "doc_id"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(suspects, f"key string, doc_id {kind}")


def dropped_keys(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(doc_id, keys)``: the keys that each document loses."""
    suspects = stored(suspected_lines(documents, min_chars), "suspected-lines")
    held = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("_one"))
    # A null doc_id is below every other one, so it is the largest only when alone.
    repeated = held.groupBy("key").agg(
        F.count("*").alias("_documents"), F.max("doc_id").alias("_kept")
    ).filter(F.col("_documents") >= min_documents).select(F.col("key").alias("_key"), "_kept")
    return held.join(repeated, F.col("key") == F.col("_key")).filter(
        ~F.col("doc_id").eqNullSafe(F.col("_kept"))
    ).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every input row as ``row`` with ``n_lines``, ``n_dropped`` and ``kept``, the text that stays."""
    lost = dropped_keys(documents, min_chars, min_documents).withColumnRenamed("doc_id", "_doc_id")
    rows = whole_rows(documents, doc_id=F.col("doc_id"), text=F.col("text")).join(
        lost, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left"
    ).select("row", "text", "keys")

    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept:string>")
    def rewritten(texts: pa.Array, keys: pa.Array) -> pa.Array:
        found = []
        for text, own in zip(texts, keys):
            lines = (text.as_py() or "").encode().split(b"\n")
            drop = {key.encode() for key in own.as_py() or ()}
            kept = [line for line in lines if line_key(line, min_chars) not in drop] if drop else lines
            found.append({
                "n_lines": len(lines), "n_dropped": len(lines) - len(kept),
                "kept": None if text.as_py() is None else b"\n".join(kept).decode(),
            })
        return pa.array(found, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]))

    return rows.select("row", rewritten("text", "keys").alias("_out")).select("row", "_out.*")


def deduplicated(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with repeated lines removed from ``text``; all other columns as they are."""
    return dedup_lines(documents, min_chars, min_documents).select(*[
        F.col("kept").alias(name) if name == "text" else F.col("row").getField(name).alias(name)
        for name in documents.columns
    ])
