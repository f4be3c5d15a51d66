"""`filetree` data source: a directory tree as file records.

Unlike `binaryFile`, it keeps names that start with `_` or `.` and empty files, and
a file of any size comes as ordered pieces. The root must be a folder that the
driver and every executor can reach.

Every directory is listed once, when partitions are planned, and not entered if it
is ignored or if a pushed filter on `rel_path` rules out all below it; filters on
sizes and times drop files there too. What remains is dealt to partitions by bytes.
Files are opened only if the schema asks for `raw`: with
`.schema("rel_path string, size long")` a scan is the listing alone.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from folioflow.defaults import ENV_DIRS, SYSTEM_NAMES

SCHEMA = "project_id string, rel_path string, piece long, raw binary, size long, mtime_s long, error string"
# A piece is cut after the first line end beyond so many bytes.
PIECE_BYTES = 32 << 20
# Bytes and files of a partition; opening a file counts as so many bytes.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
LISTED_TOGETHER = 50_000


@dataclass
class _Listed:
    """A file, or a folder that can't be listed."""

    rel_path: str
    size: int | None
    mtime_s: int | None
    error: str | None = None


@dataclass
class _Slice(InputPartition):
    """Pieces (file, number of the piece; none for the whole record without content)."""

    items: list[tuple[_Listed, int | None]] = field(default_factory=list)


# Pushed filters that the listing can decide, as tests of a value that isn't null.
_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda a, b: a == b,
    EqualNullSafe: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    IsNotNull: lambda a, b: True,
}
_LISTED = {"project_id", "rel_path", "size", "mtime_s"}


def _as_bytes(text: object) -> object:
    """Strings are compared as their UTF-8 bytes, as the engine does."""
    if isinstance(text, (tuple, list)):
        return [_as_bytes(t) for t in text]
    return text.encode(errors="surrogateescape") if isinstance(text, str) else text


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        root = options.get("root") or options.get("path")
        if not root or not os.path.isdir(root):
            raise ValueError(f"not a directory: {root!r}")
        self.root = os.path.abspath(root)
        self.columns = schema.names
        self.project_id = options.get("project_id", os.path.basename(self.root))
        self.piece_bytes = int(options.get("piece_bytes", str(PIECE_BYTES)))
        self.split_bytes = int(options.get("split_bytes", str(SPLIT_BYTES)))
        if self.piece_bytes < 4 or self.split_bytes < 1:
            raise ValueError("piece_bytes must be at least 4, split_bytes positive")
        most = options.get("max_file_bytes")
        self.max_bytes = int(most) if most else None
        env, system = options.get("skip_env", "true") == "true", options.get("skip_system", "false") == "true"
        self.skipped_names = set(SYSTEM_NAMES) if system else set()
        self.skipped_dirs = self.skipped_names | (set(ENV_DIRS) if env else set())
        blind = re.IGNORECASE if options.get("case_sensitive", "true") != "true" else 0
        globs = json.loads(options.get("ignore", "[]"))
        self.ignored = re.compile("|".join(map(fnmatch.translate, globs)), blind) if globs else None
        self.filters: list[Filter] = []

    # ---- planning

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if type(one) in _TESTS and len(one.attribute) == 1 and one.attribute[0] in _LISTED:
                self.filters.append(one)
            else:
                yield one

    def _passes(self, found: _Listed) -> bool:
        row = {"project_id": self.project_id, "rel_path": found.rel_path, "size": found.size, "mtime_s": found.mtime_s}
        for one in self.filters:
            value, wanted = row[one.attribute[0]], getattr(one, "value", None)
            if value is None:
                # Only a null-safe comparison with null holds for null.
                if not (isinstance(one, EqualNullSafe) and wanted is None):
                    return False
            elif wanted is None and not isinstance(one, IsNotNull):
                return False
            elif not _TESTS[type(one)](_as_bytes(value), _as_bytes(wanted)):
                return False
        return True

    def _may_hold(self, folder: str) -> bool:
        """Whether a file below this folder can pass the filters on paths."""
        below = folder + "/"
        for one in self.filters:
            if one.attribute[0] != "rel_path":
                continue
            if isinstance(one, (EqualTo, EqualNullSafe)) and not str(one.value).startswith(below):
                return False
            if isinstance(one, In) and not any(str(v).startswith(below) for v in one.value):
                return False
            if isinstance(one, StringStartsWith) and not (one.value.startswith(below) or below.startswith(one.value)):
                return False
        return True

    def _is_ignored(self, path: str, name: str) -> bool:
        return self.ignored is not None and bool(self.ignored.match(name) or self.ignored.match(path))

    def _listing(self) -> Iterator[_Listed]:
        pending = [""]
        while pending:
            folder = pending.pop()
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    found = sorted(entries, key=lambda e: e.name)
            except OSError as error:
                yield _Listed(folder, None, None, str(error))
                continue
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if self._is_ignored(path, entry.name):
                    continue
                try:
                    path.encode()
                    if entry.is_symlink():
                        continue
                    if entry.is_dir():
                        if entry.name not in self.skipped_dirs and self._may_hold(path):
                            pending.append(path)
                    elif entry.is_file() and entry.name not in self.skipped_names:
                        stat = entry.stat()
                        yield _Listed(path, stat.st_size, int(stat.st_mtime))
                except UnicodeEncodeError:
                    yield _Listed(os.fsencode(path).decode(errors="replace"), None, None, "name is not UTF-8")
                except OSError as error:
                    yield _Listed(path, None, None, str(error))

    def _pieces(self, found: _Listed) -> list[int | None]:
        if "raw" not in self.columns or found.error is not None:
            return [None]
        if self.max_bytes is not None and found.size > self.max_bytes:
            found.error = "larger than max_file_bytes"
            return [None]
        return list(range(max(1, -(-found.size // self.piece_bytes))))

    def partitions(self) -> list[InputPartition]:
        """Pieces in the order of the listing, as many to a partition as its bytes allow."""
        slices, weight = [_Slice()], 0
        elsewhere = any(f.attribute[0] == "project_id" and isinstance(f, EqualTo) and f.value != self.project_id for f in self.filters)
        for found in () if elsewhere else self._listing():
            if not self._passes(found):
                continue
            for piece in self._pieces(found):
                cost = OPEN_BYTES + min(found.size, self.piece_bytes) if piece is not None else self.split_bytes // LISTED_TOGETHER
                if weight and weight + cost > self.split_bytes:
                    slices.append(_Slice())
                    weight = 0
                slices[-1].items.append((found, piece))
                weight += cost
        return slices

    # ---- reading

    def _boundary(self, handle, number: int, size: int) -> int:
        """Where piece `number` begins: after a line end, else between two characters, within its share of the file."""
        at = number * self.piece_bytes
        if number == 0 or at >= size:
            return min(at, size)
        handle.seek(at - 1)
        line = handle.readline(self.piece_bytes + 1)
        if line.endswith(b"\n"):
            return at - 1 + len(line)
        # No line ends here: step over what continues a character.
        for byte in line[1:4]:
            if not 0x80 <= byte < 0xC0:
                break
            at += 1
        return at

    def _content(self, found: _Listed, piece: int) -> bytes:
        with open(os.path.join(self.root, found.rel_path), "rb") as handle:
            if found.size <= self.piece_bytes:
                return handle.read()
            start = self._boundary(handle, piece, found.size)
            stop = self._boundary(handle, piece + 1, found.size)
            handle.seek(start)
            return handle.read(max(0, stop - start))

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for found, piece in partition.items:
            raw, error = None, found.error
            if piece is not None:
                try:
                    raw = self._content(found, piece)
                except OSError as problem:
                    error = str(problem)
            row = {
                "project_id": self.project_id, "rel_path": found.rel_path, "piece": piece or 0, "raw": raw,
                "size": found.size, "mtime_s": found.mtime_s, "error": error,
            }
            yield tuple(row[c] for c in self.columns)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileTreeReader:
        return FileTreeReader(dict(self.options), schema)


def register_filetree(spark: SparkSession) -> None:
    """Make `spark.read.format("filetree").option("root", …)` available.

    Options: `project_id`; `ignore`, a JSON list of globs; `case_sensitive`;
    `skip_env`, `skip_system`; `piece_bytes`, `split_bytes`; `max_file_bytes`, above
    which a file is reported and not read (no limit unless given).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTreeSource)
