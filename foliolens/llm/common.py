"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.session import new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Rows of a broadcast table at most; callers hold rows to a fixed width.
BROADCAST_ROWS = 200_000


def whole_rows(documents: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct ``row`` beside the named columns: no column name can clash."""
    return documents.select(F.struct("*").alias("row"), *[value.alias(name) for name, value in columns.items()])


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, lineage cut."""
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast the frame if, counted, it has at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def shingle_digests(text: str | None, width: int, digest: Callable[[bytes], bytes]) -> np.ndarray:
    """64-bit hashes of the text's shingles, in order, repeats included.

    A-Z are lower-cased; words are runs of characters other than the six ASCII spaces, and
    a shingle ``width`` of them (fewer: all) joined by spaces.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    found = b"".join([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())])
    return np.frombuffer(found, ">u8").astype(np.uint64)
