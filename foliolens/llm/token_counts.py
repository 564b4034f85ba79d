r"""Token counts of whole texts, from a tokenizer file.

Texts are encoded in Arrow functions that return lengths only.  A text is split at safe
boundaries, between a non-space character and a space or line end: no token of a
byte-level tokenizer crosses them and each side is encoded as it would be inside the
whole.  Pieces are encoded in batches balanced by bytes.  A piece that was met before, by
far the most common case, is not encoded again; the memory for this is bounded.

Files: ``.json`` for ``tokenizers``; ``.model`` for ``sentencepiece``, which rewrites spaces and
so gets whole texts.  Special strings inside a text are handled as the library does by
default; no special tokens are added, nothing is padded or cut.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens; a long text without
a boundary is one piece; repeated rows each get a row; other columns pass through.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import whole_rows

LIMIT = 512
# Bytes of text encoded in one call.
BATCH_BYTES = 256 * 1024
# Pieces remembered by a worker, at most, and the longest that is remembered.
KNOWN_PIECES = 1_000_000
KNOWN_CHARS = 200
# A piece longer than this is cut at line ends too.
LONG_CHARS = 64 * 1024
# Spaces that do not follow a non-space character.
_UNEVEN = re.compile(r"\s |^ ")
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str) -> dict[str, int]:
    """How often each piece of the text occurs; put together in order, they are the text."""
    if _UNEVEN.search(text) is None:
        first, *rest = text.split(" ")
        own = {f" {piece}": number for piece, number in Counter(rest).items()}
        own[first] = own.get(first, 0) + 1
        if max(map(len, own)) <= LONG_CHARS:
            return own
    return Counter(_BOUNDARY.split(text))


class Counting:
    """Counts tokens of pieces with one library object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = path.endswith(".model")
        if self.whole:
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in own.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self.encode = lambda texts: [len(found) for found in own.encode_batch_fast(texts, add_special_tokens=False)]
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text, encoded in calls of about ``BATCH_BYTES``."""
        found, batch, held = [], [], 0
        for text in texts:
            batch.append(text)
            held += len(text.encode())
            if held >= BATCH_BYTES:
                found += self.encode(batch)
                batch, held = [], 0
        return found + (self.encode(batch) if batch else [])

    def counts(self, texts: list[str]) -> list[int]:
        if self.whole:
            return self.lengths(texts)
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        totals = [0] * len(texts)
        waiting: list[tuple[int, int, str]] = []
        unknown: dict[str, None] = {}
        for i, text in enumerate(texts):
            for piece, number in pieces(text).items():
                count = self.known.get(piece)
                if count is None:
                    waiting.append((i, number, piece))
                    unknown[piece] = None
                else:
                    totals[i] += count * number
        fresh = dict(zip(unknown, self.lengths(list(unknown))))
        for i, number, piece in waiting:
            totals[i] += fresh[piece] * number
        self.known.update((piece, count) for piece, count in fresh.items() if len(piece) <= KNOWN_CHARS)
        return totals


@lru_cache(maxsize=4)
def counting(path: str) -> Counting:
    """One per worker process and file."""
    return Counting(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of the text; the file at ``path`` must be there on every machine."""

    @F.arrow_udf("bigint")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counting(path)
        for texts in batches:
            yield pa.array(own.counts([value or "" for value in texts.to_pylist()]), pa.int64())

    return counts(text)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Every input row as ``row`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    rows = whole_rows(
        documents, n_bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"),
        n_tokens=token_count(F.col("text"), path),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
