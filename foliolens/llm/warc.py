r"""WARC archives as a Spark data source, and archiving pages with revisit records.

Writing: each task writes its own ``.warc`` files (uncompressed, so that a reader can step
over payloads) under a name no other attempt uses; on commit a manifest of that write lists the files
of the tasks that succeeded, and readers take only those that some manifest lists.  A write in mode
``overwrite`` removes the manifests of earlier ones.  Reading: files are packed into
partitions by size; predicates on record type, page id and target URI are pushed down;
a record's headers are parsed first, and unless the record is wanted and its payload asked
for (a ``payload`` column, or ``verify``), the payload is stepped over.  Archives written by
others, also ``.warc.gz``, are read when the folder has no manifest.

Equal payloads are found by SHA-256 before anything is written: only digests are shuffled,
and pages only if the list of repeated digests is too long to broadcast.

Defined cases: a null page is an empty payload; rows that share the smallest page id of
equal payloads are all responses (the smallest is null only if all are); control
characters and line ends in URLs are percent-encoded, a null URL has no header; repeated
rows are written again; an empty table gives an archive without records; other columns are
left out of the archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliolens.llm.common import stored

FORMAT = "foliolens_warc"
SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload string"
)
# Bytes after which a task begins another file, and bytes of a reading partition.
FILE_BYTES = 128 * 1024 * 1024
PARTITION_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 512
_MANIFEST = "_manifest"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP head with the payload's length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(stream: io.BufferedIOBase) -> tuple[dict[str, str], int]:
    """Header lines up to the empty line, names in lower case, and the bytes they took."""
    found, took = {}, 0
    while True:
        line = stream.readline()
        took += len(line)
        if line in (b"\r\n", b"\n", b""):
            return found, took
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()


def _skip(stream: io.BufferedIOBase, count: int) -> None:
    if isinstance(stream, gzip.GzipFile):
        while count > 0 and (read := stream.read(min(count, 1 << 20))):
            count -= len(read)
    else:
        stream.seek(count, io.SEEK_CUR)


def _page(value: str | None) -> int | None:
    """The page id of a record id; other archives' ids are none."""
    inner = (value or "").strip("<>")
    digits = inner.removeprefix(_ID)
    return int(digits) if inner.startswith(_ID) and digits.lstrip("-").isdigit() else None


def read_records(stream: io.BufferedIOBase, wanted, with_payload: bool, verify: bool) -> Iterator[dict]:
    """Records for whose headers ``wanted`` holds; payloads are read only where asked for."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers, _ = _headers(stream)
        length = int(headers.get("content-length", 0))
        row = {
            "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"),
            "record_type": headers.get("warc-type"), "refers_to": _page(headers.get("warc-refers-to")),
            "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": None, "payload": None,
        }
        if not wanted(row):
            _skip(stream, length)
            continue
        took = 0
        if headers.get("content-type", "").startswith("application/http"):
            http, took = _headers(stream)
            # The status line has no colon and is kept under its whole text.
            row["payload_bytes"] = int(http["content-length"]) if "content-length" in http else None
        whole = row["record_type"] != "revisit"
        if whole:
            row["payload_bytes"] = length - took
        if whole and (with_payload or verify):
            payload = stream.read(length - took)
            if verify and row["payload_digest"] not in (None, digest(payload)):
                raise ValueError(f"payload of record {headers.get('warc-record-id')} does not match its digest")
            if with_payload:
                row["payload"] = payload.decode("utf-8", "replace")
        else:
            _skip(stream, length - took)
        yield row


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


def _manifests(system: pafs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith(_MANIFEST) and f.base_name.endswith(".json"))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        done, sink, name, size = [], None, "", 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for page_id, url, payload, kind, refers_to in zip(*columns):
                if sink is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc", 0
                    sink = system.open_output_stream(f"{root}/{name}")
                made = record(page_id, url, (payload or "").encode(), kind, refers_to)
                sink.write(made)
                size += len(made)
                if size >= FILE_BYTES:
                    sink.close()
                    done.append((name, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        listed = sorted(file for message in messages if message for file in message.files)
        earlier = _manifests(system, root)
        with system.open_output_stream(f"{root}/{_MANIFEST}-{uuid.uuid4().hex}.json") as sink:
            sink.write(json.dumps(listed).encode())
        for name in earlier if self.overwrite else ():
            system.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for name, _ in message.files if message else ():
                system.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.schema, self.verify, self.tests = path, schema, verify, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {("record_type",), ("page_id",), ("url",)}
        for one in filters:
            if isinstance(one, (EqualTo, In, StringStartsWith, IsNotNull)) and one.attribute in known:
                self.tests.append((type(one).__name__, one.attribute[0], getattr(one, "value", None)))
            else:
                yield one

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            own = row[name]
            if own is None:
                return False
            if kind != "IsNotNull" and not (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Files]:
        system, root = pafs.FileSystem.from_uri(self.path)
        manifests = _manifests(system, root)
        if manifests:
            files = []
            for name in manifests:
                with system.open_input_stream(f"{root}/{name}") as source:
                    files += [tuple(file) for file in json.loads(source.read())]
        else:
            found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            files = sorted((f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        packed, names, size = [], [], 0
        for name, own in files:
            names.append(name)
            size += own
            if size >= PARTITION_BYTES:
                packed.append(Files(names))
                names, size = [], 0
        return packed + ([Files(names)] if names or not packed else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(self.path)
        names, kinds = self.schema.names, to_arrow_schema(self.schema)
        rows: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row[name] for row in rows], kinds.field(name).type) for name in names], schema=kinds
            )

        for name in partition.names:
            with system.open_input_file(f"{root}/{name}") as source:
                stream = gzip.GzipFile(fileobj=source) if name.endswith(".gz") else io.BufferedReader(source, 1 << 18)
                for row in read_records(stream, self.wanted, "payload" in names, self.verify):
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``format("foliolens_warc")``; options ``path`` and ``verify`` (compare payloads with their digests)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_record_types(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``(page_id, url, payload, record_type, refers_to)``: of equal payloads of at least ``min_payload``
    bytes, the smallest page id is the response and the others revisit it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("_digest"))
    repeated = stored(
        keyed.filter(F.octet_length("payload") >= min_payload).groupBy("_digest").agg(
            F.min("page_id").alias("_first"), F.count("*").alias("_pages")
        ).filter("_pages > 1").select(F.col("_digest").alias("_repeated"), "_first"),
        "repeated-payloads",
    )
    revisit = F.col("_repeated").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(repeated, F.col("_digest") == F.col("_repeated"), "left").select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, mode: str = "append") -> None:
    """Adds a record per page to the archive, or with mode ``overwrite`` writes it anew."""
    register(pages.sparkSession)
    with_record_types(pages, min_payload).write.format(FORMAT).option("path", path).mode(mode).save()


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records of an archive; without a ``payload`` column and ``verify``, payloads are not read."""
    register(spark)
    return spark.read.format(FORMAT).schema(columns).option("path", path).option("verify", str(verify).lower()).load()
