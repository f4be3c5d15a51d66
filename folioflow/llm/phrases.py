"""Removal of passages that an earlier document has: repeated-phrase automata.

1. Of every 13-word window its least 4-gram (by hash) is its anchor; equal windows
   have equal anchors, and a document has about one for five words. Anchors that
   two documents have show where passages can recur.
2. Windows with such an anchor are confirmed: by 96 bits of hashes of all 13 words
   they are held against each other, and each learns the smallest document that has
   it. A text that a smaller document has as a whole is confirmed as one passage, by
   128 bits, and sends no windows.
3. Documents with confirmed windows are dealt to tasks with them; a task chains
   them into phrases, compiles the phrases of its documents into Aho-Corasick
   automata over word numbers, one per shard of documents, and streams the
   documents through to find every occurrence, whole words only.

Anchors and windows are pre-aggregated inside tasks (`LocalFirsts`), so a passage
that a third of all documents share sends one row per chunk to its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.rows import FACTORS, LocalFirsts, WordHashes, keyed, runs_of, signed, utf8, window_hashes, window_minima

WIDTH = 13
ANCHOR_WORDS = 4
# Words of text that one automaton serves: bounds its memory, not what is found.
SHARD_WORDS = 150_000
RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window, by its start."""
    return window_minima(window_hashes(hashes, ANCHOR_WORDS), WIDTH - ANCHOR_WORDS + 1)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, salt, doc_id, known): a document's anchors; known if another document here has it."""
    words, firsts = WordHashes(), LocalFirsts()

    def flush() -> pa.RecordBatch:
        (anchor, doc), within, _, rows = firsts.take(1)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(anchor)), pa.array(within), pa.array(doc), pa.array(rows > 1)],
            ["anchor", "salt", "doc_id", "known"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            anchors = np.unique(_anchors(words.of(text.split())))
            if len(anchors) and firsts.add(anchors, np.full(len(anchors), doc_id)):
                yield flush()
    if firsts.rows:
        yield flush()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, place, ahead): windows with a shared anchor; the smallest document here that has one is `ahead` smaller.

    h2 is the salt above 32 bits of the second hash. A window that the document
    repeats is one row, at its first place; place is twice that, and 1 more if it is repeated.
    """
    one, two, firsts = WordHashes(), WordHashes(1), LocalFirsts()

    def flush() -> pa.RecordBatch:
        (h1, h2, doc, place), within, first, _ = firsts.take(2)
        salted = within.astype(np.int64) << 32 | (h2 >> np.uint64(32)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(h1)), pa.array(salted), pa.array(doc), pa.array(place), pa.array(doc - first)],
            ["h1", "h2", "doc_id", "place", "ahead"],
        )

    for batch in batches:
        for doc_id, text, shared in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            cut = text.split()
            hashes = one.of(cut)
            at = np.flatnonzero(np.isin(_anchors(hashes), np.array(shared, np.int64).view(np.uint64)))
            if not len(at):
                continue
            h1, h2 = window_hashes(hashes, WIDTH)[at], window_hashes(two.of(cut), WIDTH, 2)[at]
            _, once, times = np.unique(h1 + FACTORS[1] * h2, return_index=True, return_counts=True)
            if firsts.add(h1[once], h2[once], np.full(len(once), doc_id), 2 * at[once] + (times > 1)):
                yield flush()
    if firsts.rows:
        yield flush()


def _confirmed(words: WordHashes, cut: list[bytes], places: np.ndarray, owners: np.ndarray, copied: int | None) -> np.ndarray:
    """(start, smallest document, often) of a text's confirmed windows; all of them if it is copied as a whole.

    Places carry 32 bits of the window's hash in front, which tell rows that share a doc_id apart.
    """
    if copied is not None:
        at = np.arange(max(len(cut) - WIDTH + 1, 0))
        return np.stack([at, np.full(len(at), copied), at * 0], axis=1)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    low = np.uint64(0xFFFFFFFF)
    tags, places = places.view(np.uint64) >> np.uint64(32), (places.view(np.uint64) & low).astype(np.int64)
    at = places >> 1
    here = window_hashes(words.of(cut), WIDTH) & low
    own = at < len(here)
    own[own] = here[at[own]] == tags[own]
    return np.stack([at, owners, places & 1], axis=1)[own]


def _marked(cut: list[list[bytes]], docs: list[int], windows: list[np.ndarray]) -> list[np.ndarray]:
    """Which words of each document lie in a confirmed window of a smaller document.

    `windows` has a row (start, smallest document, often) per confirmed window.
    """
    numbers: dict[bytes, int] = {}
    coded = [tuple([numbers.setdefault(w, len(numbers)) for w in words]) for words in cut]
    covered = [np.zeros(len(words) + 1, np.int32) for words in cut]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    known: dict[tuple, int] = {}

    def add(phrase: tuple, owner: int) -> None:
        # A document may have learnt only of the smallest one in its own chunk.
        known[phrase] = min(owner, known.get(phrase, owner))

    for code, found in zip(coded, windows):
        if not len(found):
            continue
        at, owner, often = found[np.argsort(found[:, 0])].T
        # Neighbouring windows of one owner are one phrase: its windows all begin in that owner.
        chained = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(owner) != 0)]))
        begins, lengths = runs_of(chained)
        for b, n in zip(begins.tolist(), lengths.tolist()):
            add(code[at[b] : at[b] + n - 1 + WIDTH], int(owner[b]))
        # Elsewhere in the document they may come without their neighbours.
        for i in np.flatnonzero(often).tolist():
            add(code[at[i] : at[i] + WIDTH], int(owner[i]))
    for phrase, owner in known.items():
        automaton.add_word(phrase, (owner, len(phrase)))
    if known:
        automaton.make_automaton()
        for code, doc_id, cover in zip(coded, docs, covered):
            for end, (owner, length) in automaton.iter(code):
                if owner < doc_id:
                    cover[end + 1 - length] += 1
                    cover[end + 1] -= 1
    return [np.cumsum(c)[:-1] > 0 for c in covered]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(rows: list[tuple]) -> pa.RecordBatch:
        docs, cut, windows = zip(*rows)
        marks = _marked(cut, docs, windows)
        kept = [b" ".join([w for w, m in zip(words, mark.tolist()) if not m]) for words, mark in zip(cut, marks)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()), pa.array([len(c) for c in cut], pa.int64()),
                pa.array([int(m.sum()) for m in marks], pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    rows, size, hashes = [], 0, WordHashes()
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        places, owners = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.values.flatten())
        columns = batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(3).to_pylist()
        for i, (doc_id, text, copied) in enumerate(zip(*columns)):
            own, cut = slice(offsets[i], offsets[i + 1]), text.split()
            rows.append((doc_id, cut, _confirmed(hashes, cut, places[own], owners[own], copied)))
            size += len(rows[-1][1])
            if size >= SHARD_WORDS:
                yield finish(rows)
                rows, size = [], 0
    if rows:
        yield finish(rows)


def remove_repeated_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words that an earlier document's windows cover.

    Words are runs of anything but the six ASCII spaces; `kept` joins those left by
    one space. A null text has no words. Rows without a doc_id are passed on
    unchanged, as nothing is before or after them; rows that share a doc_id are
    one document in several rows, none of them earlier than the other. Texts of
    fewer than 13 words have no window. Columns other than doc_id and text are not read.
    """
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    texts = keyed(docs, "doc_id", "text")
    # Texts that a smaller document has as a whole, by document.
    keys = texts.filter("text is not null").select("doc_id", key.alias("key"))
    smallest = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = keys.join(smallest, "key").filter("first < doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("key", "first")).alias("copies"))
    copied = F.get(F.filter("copies", lambda c: c["key"] == key), 0)["first"]
    rows = texts.join(copies, "doc_id", "left").select("doc_id", "text", copied.alias("copied"))

    same = Window.partitionBy("anchor", "salt")
    shared = (
        texts.mapInArrow(_anchor_rows, "anchor long, salt long, doc_id long, known boolean")
        .select("anchor", "doc_id", (F.col("known") | (F.min("doc_id").over(same) < F.max("doc_id").over(same))).alias("known"))
        .filter("known").select("doc_id", "anchor")
        .repartition("doc_id").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    )
    candidates = rows.join(shared, "doc_id").filter("copied is null").select("doc_id", "text", "shared")
    window = Window.partitionBy("h1", "h2")
    # A document's windows come from everywhere: to add them up before they are dealt to it would only make them wider.
    flagged = (
        candidates.mapInArrow(_window_rows, "h1 long, h2 long, doc_id long, place long, ahead long")
        .select("h1", "doc_id", "place", F.min(F.col("doc_id") - F.col("ahead")).over(window).alias("first"))
        .filter("first < doc_id")
        .select("doc_id", F.shiftleft("h1", 32).bitwiseOR(F.col("place")).alias("place"), "first")
        .repartition("doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("place", "first")).alias("windows"))
    )
    # Joined on the same key as before, so that the texts' exchange is used again.
    found = rows.join(flagged, "doc_id", "left").select("doc_id", "text", "windows", "copied").mapInArrow(_cleaned, RESULT)
    none = F.lit(None).cast("array<struct<place:bigint,first:bigint>>").alias("windows")
    unkeyed = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), "text", none, F.lit(None).cast("long").alias("copied"))
    return found.unionByName(unkeyed.mapInArrow(_cleaned, RESULT))
