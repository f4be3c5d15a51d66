"""Removal of byte strings that occur twice: maximal repeats from enhanced suffix arrays.

1. Every string of 400 bytes has an anchor, the least hash of its 32-byte grams, so
   equal strings have equal anchors. A run is a stretch of starts with one anchor;
   it holds every string of that anchor there. Runs are about 190 starts long.
2. Anchors with one run anywhere have no repeat. Runs that are equal byte for byte
   are repeats as wholes. What is left, one text for each different run of an
   anchor, goes to the anchor's task.
3. The task takes a bounded number of bytes at once, leaves out what shares no
   64-byte gram with the rest, sorts the suffixes of what stays, scans their common
   prefixes with a stack, which walks the tree of common-prefix intervals,
   and keeps the intervals of 400 bytes or more whose occurrences have different
   bytes before them: the maximal repeats, each with all its occurrences.
4. Anchors with very many different runs (a hot passage amid many texts) are not
   put into one task: their strings are told apart by two hashes of all 400 bytes
   over the cluster instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.rows import FACTORS, LocalFirsts, mixed, runs_of, signed, utf8, window_minima
from folioflow.session import kept

WIDTH = 400
GRAM = 32
# Starts in one run at most: longer ones (texts with a short period) are several runs.
RUN_STARTS = 2000
# Bytes of runs whose suffixes are sorted at once; different runs of an anchor that one task compares.
SORT_BYTES = 1 << 20
HOT_RUNS = 1000
# Bytes that the first sort of suffixes looks at; grams that a part of a repeat must share.
WORD = 7
SHARED_GRAM = 64
# Occurrences that leave a task at once.
OUT_ROWS = 50_000

RUN = "anchor long, h1 long, h2 long, id long, key long, at long, starts long, own boolean"
REPEAT = "anchor long, h1 long, h2 long, offset long, length long, group long"
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * FACTORS[i]) for i in range(2)]


def gram_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of every `width` bytes, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, reach = int(FACTORS[which]), 1
    hashes = _BYTES[which][data]
    total, done = None, 0
    while True:
        if width & reach:
            own = hashes[done:]
            if total is None:
                total = own
            else:
                size = min(len(total), len(own))
                total = total[:size] * np.uint64(power) + own[:size]
            done += reach
        if reach * 2 > width:
            break
        hashes = hashes[:-reach] * np.uint64(power) + hashes[reach:]
        power, reach = power * power & (1 << 64) - 1, reach * 2
    return mixed(total[: len(data) - width + 1])


def runs_in(data: bytes) -> list[tuple[int, int, int, bool]]:
    """(anchor, start, starts, own) of a text; own: the anchor comes twice inside the run."""
    grams = gram_hashes(np.frombuffer(data, np.uint8), GRAM)
    reach = WIDTH - GRAM + 1
    least = window_minima(grams, reach)
    found = []
    for start, length in zip(*(x.tolist() for x in runs_of(least))):
        anchor = least[start]
        own = int(np.count_nonzero(grams[start : start + length - 1 + reach] == anchor)) > 1
        for at in range(start, start + length, RUN_STARTS):
            found.append((int(anchor), at, min(RUN_STARTS, start + length - at), own or length > RUN_STARTS))
    return found


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for id_, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            for anchor, at, starts, own in runs_in(data):
                digest = xxhash.xxh3_128_digest(data[at : at + starts - 1 + WIDTH])
                rows.append((anchor - (anchor >> 63 << 64), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), id_, key, at, starts, own))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["anchor", "h1", "h2", "id", "key", "at", "starts", "own"])


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted positions in the order of the text from there on, and each one's common prefix with the one before.

    Numbers from 256 on end a text; each comes once, the last one at the end of
    `data`. Ranks of seven bytes come from one sort. Then ranks of twice as many are
    made from those before, only for places whose rank is not yet theirs alone: a
    rank is the place of its first holder in the order, so the others keep theirs.
    Common prefixes are found by going back through the same ranks.
    """
    size = len(data)
    padded = np.append(data, np.full(WORD, 256, np.int32))
    packed = np.zeros(size, np.int64)
    alive = np.ones(size, bool)
    for k in range(WORD):
        symbol = padded[k : k + size]
        alive &= symbol < 256
        packed = packed << 9 | np.where(alive, symbol + 1, 0)
    order = np.argsort(packed, kind="stable")
    values = packed[order]
    first = np.ones(size, bool)
    # A word that runs into an end is like no other.
    first[1:] = (values[1:] != values[:-1]) | ~alive[order[1:]]
    rank = np.zeros(size, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(size), 0))
    ranks, reach = [rank.copy()], WORD
    at = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(at):
        places = order[at]
        pairs = rank[places].astype(np.int64) * size + rank[places + reach]
        by = np.argsort(pairs, kind="stable")
        places, pairs = places[by], pairs[by]
        order[at] = places
        first = np.ones(len(at), bool)
        first[1:] = pairs[1:] != pairs[:-1]
        rank[places] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        ranks.append(rank.copy())
        reach *= 2
        at = at[~(first & np.append(first[1:], True))]
    order = wanted[np.argsort(rank[wanted])]
    common = np.zeros(len(order), np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    # Equal ranks end before a text's end, so neither place leaves its text.
    for level in range(len(ranks) - 2, -1, -1):
        same = ranks[level][left] == ranks[level][right]
        left[same] += WORD << level
        right[same] += WORD << level
    same = np.ones(len(left), bool)
    for _ in range(WORD - 1):
        same &= data[left] == data[right]
        left += same
        right += same
    common[1:] = right - order[1:]
    return order, common


def shared_stretches(texts: list[np.ndarray], width: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of `width` bytes or more whose every gram of 64 bytes comes twice in the texts.

    Nothing outside them can be part of a repeat; whether they are repeats is not known.
    """
    gram = min(SHARED_GRAM, width)
    # A byte between texts, so that the grams of one text are told from those over its end.
    data = np.concatenate([np.append(t, np.uint8(0)) for t in texts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes = gram_hashes(data, gram)
    valid = np.ones(len(hashes), bool)
    for end in (begins[1:] - 1).tolist():
        valid[max(end - gram + 1, 0) : end + 1] = False
    places = np.flatnonzero(valid)
    own = hashes[places]
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(hashes) + 1, bool)
    twice[places[order[1:][same]]] = True
    twice[places[order[:-1][same]]] = True
    turns = np.flatnonzero(np.diff(np.concatenate([[False], twice]).astype(np.int8)))
    starts, ends = turns[::2], turns[1::2] + gram - 1
    long = ends - starts >= width
    starts, ends = starts[long], ends[long]
    owner = np.searchsorted(begins, starts, "right") - 1
    return list(zip(owner.tolist(), (starts - begins[owner]).tolist(), (ends - begins[owner]).tolist()))


def repeat_arrays(runs: list[tuple[bytes, int]], width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, runs, offsets) of the maximal repeats of at least `width` bytes: one by one, as arrays of all occurrences.

    `runs` are texts with their number of starts. The byte before a run's first
    start is not known, so a repeat that begins there counts as maximal.
    """
    texts = [np.frombuffer(text, np.uint8) for text, _ in runs]
    pieces = shared_stretches(texts, width) if texts else []
    if not pieces:
        return
    # A number of its own ends each stretch, so that no prefix goes on in the next one.
    data = np.concatenate([np.append(texts[t][start:end].astype(np.int32), 256 + i) for i, (t, start, end) in enumerate(pieces)])
    begins = np.cumsum([0] + [end - start + 1 for _, start, end in pieces])
    sizes = [min(end - start - width + 1, max(runs[t][1] - start, 0)) for t, start, end in pieces]
    wanted = np.concatenate([b + np.arange(n) for b, n in zip(begins, sizes)])
    order, common = suffix_order(data, wanted)
    piece = np.searchsorted(begins, order, "right") - 1
    owners, shift = (np.array(c, np.int64)[piece] for c in list(zip(*pieces))[:2])
    offsets = order - begins[piece] + shift
    joined = np.concatenate(texts)
    places = np.cumsum([0] + [len(t) for t in texts])[owners] + offsets
    before = np.where(offsets > 0, joined[places - 1].astype(np.int64), -1 - np.arange(len(order)))
    # Stretches of suffixes that share `width` bytes; each is a sub-tree of the interval tree.
    deep = common >= width
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        values = common[first:last].tolist() + [0]
        stack: list[tuple[int, int]] = []
        for i, value in enumerate(values):
            left = first + i - 1
            while stack and stack[-1][0] > value:
                length, left = stack.pop()
                letters = before[left : first + i]
                if (letters != letters[0]).any():
                    yield length, owners[left : first + i], offsets[left : first + i]
            if value >= width and (not stack or stack[-1][0] < value):
                stack.append((value, left))


def maximal_repeats(runs: list[tuple[bytes, int]], width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (run, offset)) of the maximal repeats, all at once."""
    return [(length, list(zip(own.tolist(), at.tolist()))) for length, own, at in repeat_arrays(runs, width)]


def _occurrences(rows: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """(run, offset, length, group) of all occurrences, some thousand at a time."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for group, (length, runs, offsets) in enumerate(repeat_arrays([(data, starts) for *_, starts, data in rows])):
        parts.append((runs, offsets, np.full(len(runs), length), np.full(len(runs), group)))
        size += len(runs)
        if size >= OUT_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*parts))
            parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts))


def _covered(rows: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """The stretches of every run that occurrences cover, as (run, offset, length, group 0): each byte once, however nested."""
    # A place more than its bytes keeps the stretches of neighbours apart.
    begins = np.cumsum([0, *(len(row[-1]) + 1 for row in rows)])
    edges = np.zeros(begins[-1] + 1, np.int64)
    for runs, offsets, lengths, _ in _occurrences(rows):
        np.add.at(edges, begins[runs] + offsets, 1)
        np.add.at(edges, begins[runs] + offsets + lengths, -1)
    inside = np.cumsum(edges) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    if len(starts):
        runs = np.searchsorted(begins, starts, "right") - 1
        yield runs, starts - begins[runs], ends - starts, np.zeros(len(runs), np.int64)


def _repeat_rows(told: Callable[[list[tuple]], Iterator[tuple[np.ndarray, ...]]]):
    """What is `told` of whole anchors (rows come sorted by anchor), several anchors at once."""
    names = ["anchor", "h1", "h2", "offset", "length", "group"]

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [np.array(k, np.int64) for k in list(zip(*rows))[:3]]
        for runs, *columns in told(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(k[runs] for k in keys), *columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and size >= SORT_BYTES and row[0] != rows[-1][0]:
                    yield from finish(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield from finish(rows)

    return run


def _texts_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, wanted in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            for r in wanted:
                rows.append((r["anchor"], r["h1"], r["h2"], r["starts"], data[r["at"] : r["at"] + r["starts"] - 1 + WIDTH]))
        if rows:
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["anchor", "h1", "h2", "starts", "data"])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, salt, known, anchor, h1, h2, offset): every 400-byte string of the runs."""
    firsts = LocalFirsts()
    names = ["w1", "w2", "salt", "known", "anchor", "h1", "h2", "offset"]

    def flush() -> pa.RecordBatch:
        (w1, w2, offset, anchor, h1, h2), within, _, rows = firsts.take(2)
        columns = signed(w1), signed(w2), within, rows > 1, anchor, h1, h2, offset
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    for batch in batches:
        for anchor, h1, h2, starts, data in zip(*(c.to_pylist() for c in batch.columns)):
            codes = np.frombuffer(data, np.uint8)
            hashes = [gram_hashes(codes, WIDTH, which) for which in range(2)]
            if firsts.add(*hashes, np.arange(starts), *(np.full(starts, x) for x in (anchor, h1, h2))):
                yield flush()
    if firsts.rows:
        yield flush()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            rows = []
            piece = batch.slice(part, 500)
            for doc_id, data, spans in zip(piece.column(0).to_pylist(), utf8(piece.column(1)), piece.column(2).to_pylist()):
                left, removed, count, done = [], 0, 0, 0
                end = -1
                for start, stop in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start > end:
                        count += 1
                        left.append(data[done:start])
                        done = start
                    if stop > done:
                        removed += stop - done
                        done = stop
                    end = max(end, stop)
                left.append(data[done:])
                rows.append((doc_id, len(data), removed, count, b"".join(left)))
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _rows(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own: equal keys only for equal rows."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(doc_id, "text").alias("key"), "text")


def find_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS, covered: bool = False) -> tuple[DataFrame, DataFrame]:
    """The repeated runs of all rows, stored (columns of RUN), and the repeats found in them.

    The second table has (anchor, h1, h2, offset, length, group): in a run with
    these hashes, `length` bytes from `offset` on also occur elsewhere; rows of one
    (anchor, group) are the occurrences of one maximal repeat. Group -1: the run
    occurs twice as a whole; group -2: strings of a hot anchor. With `covered` the
    occurrences of all groups of a run are merged to the stretches that they cover.
    """
    rows = _rows(docs)
    runs = kept(rows.select("id", "key", "text").mapInArrow(_run_rows, RUN))
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 or own")
    runs = kept(runs.join(anchors.select("anchor"), "anchor", "left_semi"))
    one = F.min(F.struct("id", "key", "at", "starts")).alias("one")
    different = runs.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n"), one, F.max("own").alias("own"))
    counts = different.groupBy("anchor").agg(F.count("*").alias("n_runs"))
    different = kept(different.join(counts, "anchor").select("anchor", "h1", "h2", "n", "one.*", "own", "n_runs"))
    whole = different.filter("n > 1").select("anchor", "h1", "h2", F.lit(0).cast("long").alias("offset"), (F.col("starts") + WIDTH - 1).alias("length"), F.lit(-1).cast("long").alias("group"))
    wanted = different.filter("n_runs > 1 or own")

    def texts(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "h1", "h2", "at", "starts")).alias("wanted"))
        # Of rows that are the same, one is enough.
        return rows.join(wanted, ["id", "key"]).select("text", "wanted").mapInArrow(
            _texts_of_runs, "anchor long, h1 long, h2 long, starts long, data binary"
        )

    cold = texts(wanted.filter(F.col("n_runs") <= hot_runs)).repartition("anchor").sortWithinPartitions("anchor", "h1", "h2")
    found = whole.unionByName(cold.mapInArrow(_repeat_rows(_covered if covered else _occurrences), REPEAT))
    if not wanted.filter(F.col("n_runs") > hot_runs).isEmpty():
        same = Window.partitionBy("w1", "w2", "salt")
        strings = texts(wanted.filter(F.col("n_runs") > hot_runs)).mapInArrow(
            _string_rows, "w1 long, w2 long, salt long, known boolean, anchor long, h1 long, h2 long, offset long"
        )
        twice = strings.withColumn("known", F.col("known") | (F.count("*").over(same) > 1)).filter("known")
        found = found.unionByName(twice.select("anchor", "h1", "h2", "offset", F.lit(WIDTH).cast("long").alias("length"), F.lit(-2).cast("long").alias("group")))
    return runs, found


def _joined_ranges(ranges: Column) -> Column:
    """Ranges (offset, length) in any order as the few (offset, end) that they cover together."""

    def add(done: Column, one: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        end = one["offset"] + one["length"]
        longer = F.struct(last["offset"].alias("offset"), F.greatest(last["end"], end).alias("end"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        alone = F.struct(one["offset"].alias("offset"), end.alias("end"))
        return F.when(last["end"] >= one["offset"], F.concat(before, F.array(longer))).otherwise(F.concat(done, F.array(alone)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<offset:bigint,end:bigint>>"), add)


def remove_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each row's UTF-8 bytes without repeated 400-byte strings.

    Every byte of a 400-byte string that starts anywhere else too goes, in its first
    place as well. A null text is empty; texts of fewer than 400 bytes stay. Rows
    with a null or repeated doc_id are texts like others: of two equal rows of 400
    bytes or more nothing stays. Columns other than doc_id and text are not read.
    """
    runs, found = find_repeats(docs, hot_runs, covered=True)
    # Nested and overlapping repeats of a run become its few covered ranges; a run has 2,000 starts at most.
    ranges = found.groupBy("anchor", "h1", "h2").agg(_joined_ranges(F.collect_set(F.struct("offset", "length"))).alias("ranges"))
    placed = runs.join(ranges, ["anchor", "h1", "h2"]).select("id", "key", "at", F.explode("ranges").alias("r"))
    spans = placed.select("id", "key", (F.col("at") + F.col("r.offset")).alias("start"), (F.col("at") + F.col("r.end")).alias("end"))
    spans = spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    told = _rows(docs).join(spans, ["id", "key"], "left").select("doc_id", "text", "spans")
    return told.mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
