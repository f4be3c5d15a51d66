"""Runs of repeated words: stretches that repeat with a period, found by frequency splitting.

A run of period q has at least four periods, so each of its words occurs four times
in it. Words that occur less often within a segment can be in no run of it and split
it; the parts are counted anew until nothing splits. Surviving segments are scanned
lag by lag. Short lags compare every word with the one a lag further. For a long lag
q it is enough to look at every q-th place, as words q apart agree for three lags in
a row: there the hashes of the next g <= q words have to agree twice, and only what
does is compared word by word. Over all lags that is n log n, not n squared.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.rows import FACTORS, mixed, of_batches, utf8

# Fixed by the definition of a run: it has at least so many periods, and so many words.
PERIODS, LEAST_WORDS = 4, 6
# Up to this lag all words are compared, beyond it every lag-th place.
FULL_LAGS = 64
# A round of splitting that drops less than one word in so many is the last one. What it
# leaves whole is scanned, so this decides on time only.
SLOW = 256

Run = tuple[int, int, int]


def surviving(words: np.ndarray) -> list[tuple[int, int]]:
    """Segments (from, to) in which every word occurs often enough to be in a run."""
    done, open_ = [], [(0, len(words))] if len(words) >= LEAST_WORDS else []
    while open_:
        at = np.concatenate([np.arange(a, b) for a, b in open_])
        segment = np.repeat(np.arange(len(open_)), [b - a for a, b in open_])
        keys = segment * (int(words.max()) + 1) + words[at]
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        rare = counts[which] < PERIODS
        cut = np.zeros(len(open_), bool)
        cut[segment[rare]] = True
        done += [part for part, split in zip(open_, cut.tolist()) if not split]
        # What is left between rare words and the ends of segments.
        left = ~rare & cut[segment]
        edges = np.flatnonzero(left)
        if not len(edges):
            break
        breaks = np.flatnonzero((np.diff(at[edges]) > 1) | (np.diff(segment[edges]) > 0))
        first = at[edges[np.append(0, breaks + 1)]]
        last = at[edges[np.append(breaks, len(edges) - 1)]] + 1
        parts = [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= LEAST_WORDS]
        if sum(b - a for a, b in parts) * SLOW > len(at) * (SLOW - 1):
            done += parts
            break
        open_ = parts
    return sorted(done)


def _reach(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places around `at` from which words a lag apart agree: the first, and the one after the last."""
    n, step, left, right = len(words) - lag, 64, at, at
    while left > 0:
        begin = max(0, left - step)
        differ = np.flatnonzero(words[begin:left] != words[begin + lag : left + lag])
        if len(differ):
            left = begin + int(differ[-1]) + 1
            break
        left, step = begin, step * 2
    step = 64
    while right < n:
        end = min(n, right + step)
        differ = np.flatnonzero(words[right:end] != words[right + lag : end + lag])
        if len(differ):
            right += int(differ[0])
            break
        right, step = end, step * 2
    return left, right


def segment_runs(words: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a segment, by lag scan.

    Lags go up, so a stretch whose smallest period is a divisor of the lag has been
    found before, with the same ends: a repeated stretch is skipped.
    """
    n, runs, seen = len(words), [], set()
    for lag in range(1, min(FULL_LAGS, n // PERIODS) + 1):
        differ = np.flatnonzero(words[:-lag] != words[lag:])
        bounds = np.concatenate([[-1], differ, [n - lag]])
        for i in np.flatnonzero(np.diff(bounds) > max((PERIODS - 1) * lag, LEAST_WORDS - lag)).tolist():
            start, end = int(bounds[i]) + 1, int(bounds[i + 1]) + lag
            if (start, end) not in seen:
                seen.add((start, end))
                runs.append((start, end - start, lag))
    if n // PERIODS <= FULL_LAGS:
        return runs

    inside = np.full(n, -1, np.int64)
    for number, (start, length, _) in enumerate(runs):
        inside[start : start + length] = number
    known = np.array(runs, np.int64).reshape(-1, 3)
    width, hashes = 1, mixed(words.astype(np.uint64) * FACTORS[0] + FACTORS[2])
    for lag in range(FULL_LAGS + 1, n // PERIODS + 1):
        while width * 2 <= lag:
            hashes = mixed(hashes[:-width] * FACTORS[0] + hashes[width:])
            width *= 2
        every = hashes[::lag]
        same = every[1:] == every[:-1]
        spots = np.flatnonzero(same[1:] & same[:-1]) * lag
        if not len(spots):
            continue
        run = inside[spots + lag]
        if len(known):
            start, length, period = known[run].T
            old = (run >= 0) & (start <= spots) & (spots + 2 * lag + width <= start + length) & (lag % period == 0)
            spots = spots[~old]
        upto = -1
        for spot in spots.tolist():
            if spot < upto:
                continue
            left, upto = _reach(words, spot, lag)
            end = upto + lag
            if upto - left >= (PERIODS - 1) * lag and (left, end) not in seen:
                seen.add((left, end))
                inside[left:end] = len(runs)
                runs.append((left, end - left, lag))
                known = np.array(runs, np.int64)
    return runs


def find_runs(words: np.ndarray) -> list[Run]:
    """All runs of a text, given as numbers that tell its words apart, by start and then period."""
    found = [(a + start, length, period) for a, b in surviving(words) for start, length, period in segment_runs(words[a:b])]
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods, exactly compared; of equals the first, then that of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if each run is cut to its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by a hash of the doc_id, with a tail that repeats; others as they are.

    Without a doc_id there is no hash, and the words stay.
    """
    n = len(words)
    if doc_id is None or not n:
        return words
    number = zlib.crc32(str(doc_id).encode())
    if number % 10:
        return words
    number //= 10
    at = number % n
    period = 1 + (n - at) // (3 + number % 8)
    root = words[at : at + period]
    return words[:at] + (root * ((n - at) // len(root) + 1))[: n - at]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string()),
])
DDL = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
# Rows of a result are handed on in batches of about so many characters.
BATCH_CHARS = 16 << 20


def _row(doc_id: int | None, text: bytes, change: Callable | None) -> tuple:
    words = text.split()
    if change is not None:
        words = change(doc_id, words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = find_runs(ids) if len(ids) else []
    best = strongest(runs)
    if runs:
        words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
    start, length, period = best or (None, None, None)
    exponent = 1000 * length // period if best else None
    listed = [{"start": s, "length": n, "period": q} for s, n, q in runs]
    return doc_id, len(ids), len(runs), start, length, period, exponent, listed, b" ".join(words).decode()


def collapse_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the strongest run (start, length, period, exponent_milli), runs, collapsed.

    Words are runs of anything but the six ASCII spaces. A run is a stretch with
    smallest period q of at least 6 and 4 q words that no neighbour extends; `runs`
    lists all of them by start and period, `collapsed` holds the words that no run
    holds after its first period, joined by one space. `change` may alter the words
    of a document first. A null or empty text, or one of spaces, has no words, no runs
    (the four columns of the strongest are null, `runs` is empty) and an empty
    `collapsed`. Each row is judged on its own: repeated rows give equal results, a
    null doc_id stays null. Columns other than doc_id and text are not read. A task
    holds one batch and one text's words at a time; nothing is shuffled.
    """

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, chars = [], 0
        for doc_id, text in zip(rows.column(0).to_pylist(), utf8(rows.column(1))):
            found.append(_row(doc_id, text, change))
            chars += len(text)
            if chars > BATCH_CHARS:
                yield _as_batch(found)
                found, chars = [], 0
        if found:
            yield _as_batch(found)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of_batches(batch), DDL)


def _as_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*found), FOUND)], schema=FOUND)
