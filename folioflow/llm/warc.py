"""WARC archives and a two-level capture index.

Every page becomes a record, compressed on its own, so that it can be read by a
range. The capture index holds a line per record under its reversed-host URL key
(com,example)/path; lines are sorted over the cluster, cut into compressed blocks,
and each index file ends with a sparse directory of its blocks' first keys. A
lookup finds the file by its key range, then the block by binary search in the
directory, reads that block by range, and then the record by range.
"""

from __future__ import annotations

import bisect
import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.simple8b import filesystem
from folioflow.session import ensure_checkpoint_dir, kept

BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
ENTRY = "surt string, file string, offset long, length long"
SHARD = "first string, last string, file string, n_blocks long, n_lines long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: lower-case host labels in reverse, then the path and query."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return f")/{url}"
    path = parts.path + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path or '/'}"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data, in built-in functions."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest = F.sha1(data)
    parts = []
    for at in range(0, 40, 10):  # 40 bits are eight base32 digits
        part = F.lpad(F.conv(F.substring(digest, at + 1, 10), 16, 32), 8, "0")
        parts.append(F.translate(F.upper(part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", alphabet))
    return F.concat(*parts)


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _number(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed on its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(url.splitlines())
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _urn(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n", 5, mtime=0)


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD from one compressed record."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    return (
        _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
        int(told["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        _number(fields.get("WARC-Refers-To")), None if revisit else payload,
    )


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the entries (surt, file, offset, length).

    The payload is the html in UTF-8, null is empty. Of rows with equal payloads of
    at least `min_bytes` bytes that with the largest page_id is the response and the
    others are revisits that refer to it; rows that share its page_id as well are
    responses like it, and so is a payload that only rows without a page_id have.
    A null url gives no target and sorts under the empty host; other columns are
    not read. A task writes an archive under a name of its own; only archives of
    tasks that succeeded have entries.
    """
    folder = f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    # Who refers to whom is settled on narrow rows; then each page gets its line by its own id.
    narrow = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    marks = (
        narrow.join(first.filter("n > 1"), "digest")
        .filter(F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull()))
        .select(F.col("page_id").alias("_page_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("digest") == F.col("_digest"))
    told = rows.join(marks, same, "left").select("page_id", "url", "digest", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            for batch in batches:
                entries = []
                for page_id, url, digest, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(page_id, url, payload, digest, refers_to, refers_to is not None)
                    entries.append((surt(url), f"{folder}/{name}", sink.tell(), len(data)))
                    sink.write(data)
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries)], ["surt", "file", "offset", "length"])

    return kept(told.mapInArrow(run, ENTRY))


def write_index(entries: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the entries into index files; returns one row per file: first and last key, path, blocks, lines."""
    folder = f"{ensure_checkpoint_dir(entries.sparkSession)}/cdx-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.cdx"
        directory: list[tuple[str, int, int]] = []
        waiting: list[tuple] = []
        last, lines = "", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            def flush() -> None:
                data = gzip.compress("\n".join(json.dumps(row) for row in waiting).encode(), 5, mtime=0)
                directory.append((waiting[0][0], sink.tell(), len(data)))
                sink.write(data)
                waiting.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    waiting.append(row)
                    last, lines = row[0], lines + 1
                    if len(waiting) == block_lines:
                        flush()
            if waiting:
                flush()
            place = sink.tell()
            sink.write(gzip.compress(json.dumps(directory).encode(), mtime=0) + struct.pack("<Q", place))
        if directory:
            row = [[directory[0][0]], [last], [f"{folder}/{name}"], [len(directory)], [lines]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["first", "last", "file", "n_blocks", "n_lines"])

    columns = ("surt", "file", "offset", "length")
    ordered = entries.select(*columns).repartitionByRange("surt", "file", "offset").sortWithinPartitions(*columns[:3])
    return kept(ordered.mapInArrow(run, SHARD))


class IndexFile:
    """An open index file: its directory, and blocks by range."""

    def __init__(self, path: str):
        store, place = filesystem(path)
        self.source = store.open_input_file(place)
        size = self.source.size()
        start = struct.unpack("<Q", self._range(size - 8, 8))[0]
        self.directory = json.loads(gzip.decompress(self._range(start, size - 8 - start)))
        self.keys = [key for key, *_ in self.directory]

    def _range(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, number: int) -> list[list]:
        _, offset, length = self.directory[number]
        return [json.loads(line) for line in gzip.decompress(self._range(offset, length)).split(b"\n")]

    def find(self, key: str) -> list[list]:
        """All lines of a key: from the last block that may start before it, by binary search in each block."""
        found = []
        number = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while number < len(self.keys) and self.keys[number] <= key:
            lines = self.block(number)
            at = bisect.bisect_left(lines, key, key=lambda line: line[0])
            while at < len(lines) and lines[at][0] == key:
                found.append(lines[at])
                at += 1
            number += 1
        return found

    def close(self) -> None:
        self.source.close()


def _batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ENTRY = pa.schema([("surt", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def index_entries(shards: DataFrame) -> DataFrame:
    """All lines of an index, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = IndexFile(path)
                for number in range(len(index.directory)):
                    yield _batch(zip(*index.block(number)), _ENTRY)
                index.close()

    return shards.select("file").repartition(max(shards.count(), 1), "file").mapInArrow(run, ENTRY)


def lookup(shards: DataFrame, urls: DataFrame) -> DataFrame:
    """Entries of the keys of (url): each goes to the files whose key range holds it, and is searched there.

    What every task holds is one row per index file, as many as the index had partitions.
    """
    files = sorted(tuple(row) for row in shards.select("first", "last", "file").collect())
    firsts = [first for first, *_ in files]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in {surt(u) for u in batch.column(0).to_pylist()}:
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and files[at][1] >= key:
                    found.append((files[at][2], key))
                    at -= 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["file", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, index = None, None
        for batch in batches:
            found = []
            for file, key in zip(*(c.to_pylist() for c in batch.columns)):
                if file != path:
                    if index:
                        index.close()
                    path, index = file, IndexFile(file)
                found += index.find(key)
            if found:
                yield _batch(zip(*found), _ENTRY)
        if index:
            index.close()

    placed = urls.select(F.col("url").cast("string")).mapInArrow(keys, "file string, key string").distinct()
    return placed.repartition("file").sortWithinPartitions("file", "key").mapInArrow(run, ENTRY)


def read_records(entries: DataFrame) -> DataFrame:
    """The records of entries, each read by its range; a task reads an archive's ranges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != path:
                    if source:
                        source.close()
                    store, place = filesystem(file)
                    path, source = file, store.open_input_file(place)
                source.seek(offset)
                rows.append(parse_record(source.read(length)))
                size += len(rows[-1][-1] or b"")
                if size > 1 << 22:
                    yield _batch(zip(*rows), _RECORD)
                    rows, size = [], 0
            if rows:
                yield _batch(zip(*rows), _RECORD)
        if source:
            source.close()

    dealt = entries.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)


def capture(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives and their index; returns the index's files (see `write_index`)."""
    return write_index(write_archives(pages, min_bytes), block_lines)


def read_archives(shards: DataFrame) -> DataFrame:
    """Every record that an index leads to."""
    return read_records(index_entries(shards))

