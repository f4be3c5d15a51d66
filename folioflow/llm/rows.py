"""Helpers of the operators: stable hashes of words, windows and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Any odd numbers do; they are fixed so that every task hashes alike.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
REMEMBERED = 400_000


class Remembered(dict):
    """A dictionary of two generations: when the young one is full, it becomes the old one.

    What is in use moves to the young one as it is asked for, so common keys stay
    and the number of keys is bounded by twice `size`.
    """

    def __init__(self, size: int = 600_000):
        super().__init__()
        self.size, self.old = size, {}

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class WordHashes(dict):
    """The 64-bit hash of byte strings; remembers a bounded number of them."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray, factor: np.uint64 = FACTORS[1]) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    values = values ^ (values >> np.uint64(31))
    values = values * factor
    values ^= values >> np.uint64(29)
    return values


def window_hashes(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of every run of `width` neighbours, by its start."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, width):
        out *= FACTORS[which]
        out += hashes[i : i + count]
    return mixed(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of `width` neighbours, by its start."""
    if len(values) < width:
        return values[:0]
    least, reach = values, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def utf8(texts: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def keyed(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """The rows that have a key, with the key as a long, and the named columns only."""
    return table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), *columns)


def of_batches(
    function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one batch as a function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return run


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of every run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


class LocalFirsts:
    """Pre-aggregates (key, owner) rows inside a task before they are shuffled.

    Of the rows of a chunk that share a key only the one with the smallest owner
    goes to that key's place (salt 0); the others are known to share it and
    travel alone (salt = their number), so that however common a key is, its
    place gets one row per chunk.
    """

    def __init__(self, chunk_rows: int = 400_000):
        self.chunk_rows = chunk_rows
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.rows += len(columns[0])
        return self.rows >= self.chunk_rows

    def take(self, keys: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """All columns; the salt; the smallest owner of the key here; rows of the key here.

        The first `keys` columns are the key, the next one is the owner.
        """
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.rows = [], 0
        order = np.lexsort([columns[keys], *columns[:keys]])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in columns[:keys]:
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(order)))
        within = np.arange(len(order)) - np.repeat(starts, counts)
        return columns, within, np.repeat(columns[keys][starts], counts), np.repeat(counts, counts)
