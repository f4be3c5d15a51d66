"""Byte-level byte-pair encoding and decoding.

The merge loop keeps every possible merge in a queue of ranks: a bucket per rank
holds the left ends of the pairs with that rank, a bitmap of three levels says
which buckets hold anything, and find-first-set on three words gives the next
rank. The symbols form a linked list. A bucket entry whose pair has changed
meanwhile is stale and skipped. A merge costs a constant number of word
operations whatever the length, so a pre-token of a million bytes is encoded in
time in proportion to its length (but for a heap inside a bucket).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioflow.llm.rows import Remembered

# Stretches of text that a worker remembers, in each of two generations: some 50 MB together.
REMEMBERED = 200_000
# Characters of pre-tokens that share a queue.
MERGED_AT_ONCE = 1 << 16


def no_ranks(count: int) -> tuple[list[int], list[int]]:
    """The two lower levels of an empty bitmap of `count` ranks."""
    return [0] * (count + 63 >> 6), [0] * (count + 4095 >> 12)


def merge(piece: bytes, ranks: dict[bytes, int], count: int | None = None) -> list[int]:
    """Ids of one pre-token: always the leftmost pair of the lowest rank is merged next."""
    return np.frombuffer(merge_all([piece], ranks, no_ranks(count or len(ranks)))[0], "<u4").tolist()


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], levels: tuple[list[int], list[int]]) -> list[bytes]:
    """Ids of many pre-tokens as 32-bit numbers; in each always the leftmost pair of the lowest rank is merged next.

    Pre-tokens stand one after another with a gap between, and share one queue:
    all pairs of the lowest rank are merged from left to right, until a pair of a
    lower rank turns up. `low`, `middle` and `top` are the levels of the bitmap (64
    ranks, 64 words and all blocks); `buckets` hold positions. The bitmap is empty
    at the end, so `levels`, made by `no_ranks`, serve one call after another.
    """
    rank_of = ranks.get
    text = b"\0".join(pieces) + b"\0"
    size = len(text)
    end = list(range(1, size + 1))  # of the symbol that starts here; 0 in a gap
    before = list(range(-1, size - 1))
    pair = [rank_of(text[i : i + 2]) for i in range(size)]  # rank of this symbol with the next one
    at, begins = 0, []
    for piece in pieces:
        begins.append(at)
        before[at] = -1
        at += len(piece) + 1
        end[at - 1] = 0
        pair[at - 1] = pair[at - 2] = None
        if piece in ranks:
            pair[begins[-1] : at - 1] = [None] * len(piece)
    low, middle = levels
    top = 0
    buckets: dict[int, list[int]] = {}
    for left, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(left)
            else:
                buckets[rank] = [left]
                word, block = rank >> 6, rank >> 12
                low[word] |= 1 << (rank & 63)
                middle[block] |= 1 << (word & 63)
                top |= 1 << block
    while top:
        # Find-first-set, level by level.
        block = (top & -top).bit_length() - 1
        bits = middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        bucket.sort(reverse=True)
        lower = False
        while bucket and not lower:
            left = bucket.pop()
            if pair[left] != rank:
                continue
            right = end[left]
            stop = end[left] = end[right]
            pair[right] = pair[left] = None
            previous, after = before[left], end[stop]
            if after:
                before[stop] = left
                fresh = rank_of(text[left:after])
                if fresh is not None:
                    pair[left] = fresh
                    lower = fresh < rank
                    if fresh in buckets:
                        buckets[fresh].append(left)
                    else:
                        buckets[fresh] = [left]
                        at, high = fresh >> 6, fresh >> 12
                        low[at] |= 1 << (fresh & 63)
                        middle[high] |= 1 << (at & 63)
                        top |= 1 << high
            if previous >= 0:
                pair[previous] = fresh = rank_of(text[previous:stop])
                if fresh is not None:
                    lower = lower or fresh < rank
                    if fresh in buckets:
                        buckets[fresh].append(previous)
                    else:
                        buckets[fresh] = [previous]
                        at, high = fresh >> 6, fresh >> 12
                        low[at] |= 1 << (fresh & 63)
                        middle[high] |= 1 << (at & 63)
                        top |= 1 << high
        if not bucket:
            del buckets[rank]
            low[word] = bits = low[word] & ~(1 << (rank & 63))
            if not bits:
                middle[block] = bits = middle[block] & ~(1 << (word & 63))
                if not bits:
                    top &= ~(1 << block)
    out = []
    for at, piece in zip(begins, pieces):
        whole = rank_of(piece)
        if whole is not None:
            out.append(whole.to_bytes(4, "little"))
            continue
        ids = array("I")
        stop = at + len(piece)
        while at < stop:
            after = end[at]
            ids.append(ranks[text[at:after]])
            at = after
        out.append(ids.tobytes())
    return out


class Codec(Remembered):
    """Encodes and decodes with one vocabulary; remembers a bounded number of stretches of text."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        super().__init__(remembered)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.count = max(self.ranks.values(), default=0) + 1
        self.levels = no_ranks(self.count)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern)

    def _learn(self, stretches: set[str]) -> list[str]:
        """Encodes stretches that are not known yet; returns those too long to be remembered."""
        old = self.old
        self.update((s, old[s]) for s in stretches if s in old)
        cut = {s: self.pieces.findall(s) for s in stretches if s not in old}
        new = set(chain.from_iterable(cut.values())).difference(self)
        self.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in old]
        at, long = 0, []
        while at < len(new):
            # A bounded number of characters at a time, one pre-token at least.
            stop, size = at, 0
            while stop < len(new) and (stop == at or size + len(new[stop]) <= MERGED_AT_ONCE):
                size += len(new[stop])
                stop += 1
            some = new[at:stop]
            self.update(zip(some, merge_all([p.encode() for p in some], self.ranks, self.levels)))
            long += [p for p in some if len(p) > 40]
            at = stop
        for s, pieces in cut.items():
            if len(pieces) != 1:
                self[s] = b"".join(map(self.__getitem__, pieces))
                if len(s) > 40:
                    long.append(s)
        return long

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers.

        A pre-token begins at every space that something other than white space
        follows, so a text is cut there, and equal stretches are looked up.
        """
        self.age()
        cut = [self._stretches(t) for t in texts]
        new = set().union(*cut).difference(self)
        long = self._learn(new) if new else []
        out = [b"".join(map(self.__getitem__, stretches)) for stretches in cut]
        for s in long:
            self.pop(s, None)
        return out

    def _stretches(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACED.search(text):
            return BEFORE_WORDS.split(text)
        first, *rest = text.split(" ")
        rest = [" " + r for r in rest]
        return [first, *rest] if first else rest

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


# Where a space is followed by white space, or ends the text, it begins no pre-token with what follows.
SPACED = regex.compile(r" (?:\s|\Z)")
BEFORE_WORDS = regex.compile(r"(?= \S)", regex.V1)


@lru_cache(maxsize=1)
def codec(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(path, pattern, remembered)


def encode_documents(docs: DataFrame, path: str, pattern: str, *passed: str) -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text as little-endian 32-bit numbers.

    A null text is empty and has no ids; doc_id is passed on as it is, null or
    repeated, and so are the columns named in `passed`; others are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                ids = own.encode_all([t or "" for t in piece.column(1).to_pylist()])
                columns = [piece.column(0), pa.array(ids, pa.binary()), *piece.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", *passed])

    return rows.mapInArrow(run, _schema(rows.drop("_text"), "ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds `data`, the bytes that `ids` stand for. Null ids give no bytes; all columns are passed on."""
    at, names = encoded.columns.index("ids"), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                data = [own.decode(np.frombuffer(i or b"", "<u4")) for i in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(data, pa.binary())], [*names, "data"])

    return encoded.mapInArrow(run, encoded.withColumn("data", F.lit(b"")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *passed: str, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, ids, data) in one pass: every row's token ids, and the bytes that they stand for; rows as in `encode_documents`.

    `remembered` bounds what a worker keeps, some 130 bytes each in two generations; it decides on time only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, remembered)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                ids = own.encode_all([t or "" for t in piece.column(1).to_pylist()])
                data = [own.decode(np.frombuffer(i, "<u4")) for i in ids]
                columns = [piece.column(0), pa.array(ids, pa.binary()), *piece.columns[2:], pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", *passed, "data"])

    return rows.mapInArrow(run, _schema(rows.drop("_text"), "ids").add(StructField("data", BinaryType())))


def _schema(rows: DataFrame, name: str) -> StructType:
    """The schema of `rows` with a binary column after the first."""
    first, *rest = rows.schema.fields
    return StructType([first, StructField(name, BinaryType()), *rest])
