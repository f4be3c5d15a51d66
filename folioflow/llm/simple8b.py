"""Token ids in files of Simple-8b words.

Of each 64-bit word the top four bits select how many ids of how many bits the
other sixty hold. Selector 0 is the escape: as many whole 64-bit words follow as
its payload says, for values of sixty bits or more. A file is a run of blocks that
are encoded on their own, then a footer (an Arrow stream) with every block's
offset and length and every document's id and length, then the footer's place. A
block is decoded selector by selector, not word by word.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm.rows import Remembered, utf8
from folioflow.session import ensure_checkpoint_dir, kept

# Fixed values of the format: ids per word by selector, and bits per id.
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
MAGIC = b"IDS8B\x01"
BLOCK_IDS = 1 << 16
END_ID = 1
# Words that a worker remembers, in each of two generations.
REMEMBERED = 600_000
# Texts of about so many bytes are encoded together.
PIECE_BYTES = 1 << 21


def _chosen(widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best selector at every position, and how many values it takes there."""
    n = len(widths)
    selector = np.full(n, ESCAPE, np.uint8)
    step = np.ones(n, np.int64)
    for s in range(len(COUNTS) - 1, 0, -1):
        # The widest of the next COUNTS[s] values; beyond the end there is nothing to hold.
        count, reach, most = COUNTS[s], 1, widths
        while reach * 2 <= count:
            most = np.maximum(most, np.append(most[reach:], np.zeros(min(reach, n), most.dtype))[:n])
            reach *= 2
        rest = count - reach
        if rest:
            most = np.maximum(most, np.append(most[rest:], np.zeros(min(rest, n), most.dtype))[:n])
        fits = most <= BITS[s]
        if not fits.any():
            break
        selector[fits] = s
        step[fits] = count
    return selector, step


def encode_block(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    widths = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    selector, step = _chosen(widths)
    starts, at, steps = [], 0, step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = selector[starts]
    padded = np.append(values, np.zeros(max(COUNTS), np.uint64))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        if BITS[s]:
            own = starts[chosen == s]
            packed = np.zeros(len(own), np.uint64)
            for k in range(COUNTS[s]):
                packed |= padded[own + k] << np.uint64(k * BITS[s])
            words[chosen == s] |= packed
    escaped = chosen == ESCAPE
    if not escaped.any():
        return words
    # An escape word, with the number of raw words after it, before each run of wide values.
    first = escaped & ~np.append(False, escaped[:-1])
    ends = np.flatnonzero(escaped & ~np.append(escaped[1:], False))
    begins = np.flatnonzero(first)
    words[escaped] = values[starts[escaped]]
    return np.insert(words, begins, (ends - begins + 1).astype(np.uint64))


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    skip = np.zeros(len(words), bool)
    after = 0
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if at >= after:
            after = at + 1 + int(words[at])
            raw[at + 1 : after] = True
            skip[at] = True
    counts = np.array(COUNTS)[selector]
    counts[raw] = 1
    counts[skip] = 0
    offsets = np.cumsum(counts) - counts
    out = np.zeros(n + max(COUNTS), np.uint64)
    for s in np.unique(selector[~raw & ~skip]).tolist():
        own = np.flatnonzero((selector == s) & ~raw)
        if BITS[s]:
            mask = np.uint64((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[offsets[own] + k] = words[own] >> np.uint64(k * BITS[s]) & mask
    out[offsets[raw]] = words[raw]
    return out[:n]


class IdFile:
    """Writes one file, document after document."""

    def __init__(self, sink):
        self.sink = sink
        self.sink.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            block = ids[at : min(at + BLOCK_IDS, whole)]
            words = encode_block(block)
            self.blocks.append((self.sink.tell(), len(words), len(block)))
            self.sink.write(words.astype("<u8").tobytes())
        self.waiting = [ids[whole:]]
        self.held = len(ids) - whole

    def close(self) -> int:
        """Writes the footer; returns how many ids the file holds."""
        self._write(True)
        place = self.sink.tell()
        for names, rows in ((("offset", "words", "ids"), self.blocks), (("doc_id", "n_tokens"), self.documents)):
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            batch = pa.RecordBatch.from_arrays(columns, list(names))
            buffer = pa.BufferOutputStream()
            with pa.ipc.new_stream(buffer, batch.schema) as out:
                out.write_batch(batch)
            data = buffer.getvalue().to_pybytes()
            self.sink.write(struct.pack("<Q", len(data)) + data)
        self.sink.write(struct.pack("<Q", place) + MAGIC)
        return sum(length for _, length in self.documents)


def read_id_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in order; the footer gives the blocks, which are read by range."""
    tail = 8 + len(MAGIC)
    source.seek(source.size() - tail)
    place, magic = struct.unpack(f"<Q{len(MAGIC)}s", source.read(tail))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    source.seek(place)
    blocks, documents = (
        pa.ipc.open_stream(source.read(struct.unpack("<Q", source.read(8))[0])).read_all() for _ in range(2)
    )
    ready, held = [], 0
    todo = zip(*(blocks[c].to_pylist() for c in ("offset", "words", "ids")))
    for doc_id, length in zip(documents["doc_id"].to_pylist(), documents["n_tokens"].to_pylist()):
        while held < length:
            offset, words, ids = next(todo)
            source.seek(offset)
            ready.append(decode_block(np.frombuffer(source.read(8 * words), "<u8"), ids))
            held += ids
        data = np.concatenate(ready) if len(ready) != 1 else ready[0]
        yield doc_id, data[:length]
        ready, held = [data[length:]], held - length


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and uri[6:7] != "/" else uri)


class WordIds(Remembered):
    """Ids of words by the tokenizers library; it is asked once per word, many words at a time.

    The vocabulary's text is composed and put into lower case, cut at white space, and
    cut again where letters meet a full stop or comma, before anything is merged; so
    the ids of a text are those of its words one after another, and of "word," those
    of "word" and ",". ASCII letters are put into lower case before words are looked
    up, but where a special token or a mark that composes with a letter may follow.
    """

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        # A task has one core; the library's own threads would wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        if any(set(token) & set(string.whitespace) for token in special):
            raise ValueError("a special token with white space")
        self.direct = not any(token.isascii() and token.isalpha() for token in special)
        # A byte that each of them holds, and the first bytes of marks that compose with an
        # ASCII letter: words with none of these are the same to the library in lower case.
        self.signs = {max(token.encode(), key=lambda b: not chr(b).isalnum()) for token in special if token} | {0xCC, 0xCD}

    def _plain(self, text: bytes) -> bool:
        return not any(sign in text for sign in self.signs)

    def _lowered(self, text: bytes) -> bytes:
        if self._plain(text):
            return text.lower()
        return b" ".join(w.lower() if self._plain(w) else w for w in text.split())

    def _learn(self, words: list[bytes]) -> None:
        # Words of ASCII letters are one piece each, of which the library's model can be asked without the steps before.
        if self.direct:
            merge = self.library.model.tokenize
            self.update((w, array("I", [t.id for t in merge(w.decode())]).tobytes()) for w in words if w.isalpha() and w.islower())
            words = [w for w in words if w not in self]
        # One call for all others, each a text of its own; a token says which word it is of.
        found = self.library.encode_batch([[w.decode() for w in words]], is_pretokenized=True, add_special_tokens=False)[0]
        ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words)))).tolist()
        data = array("I", found.ids).tobytes()
        self.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _know(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self]
        if not new:
            return
        old = self.old
        self.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        marked = [w for w in new if w[-1:] in (b".", b",") and w[-2:-1].isalpha()]
        ask = list({w[:-1] for w in marked if w[:-1] not in self} | {b".", b","} | set(new).difference(marked))
        for at in range(0, len(ask), 4096):
            self._learn(ask[at : at + 4096])
        self.update((w, self[w[:-1]] + self[w[-1:]]) for w in marked)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Texts are cut, and their different words found, by Arrow; only those are looked up."""
        self.age()
        lowered = pa.array(map(self._lowered, texts), pa.large_binary())
        cut = pc.ascii_split_whitespace(lowered.view(pa.large_string()))
        words = cut.values.view(pa.large_binary()).dictionary_encode()
        # White space at an end gives a word of no bytes, and that no ids.
        known = words.dictionary.to_pylist()
        self[b""] = b""
        self._know(known)
        ids = pa.array(map(self.__getitem__, known), pa.large_binary()).take(words.indices)
        _, places, data = ids.buffers()
        if data is None or not len(ids):
            return [np.zeros(0, "<u4") for _ in texts]
        ends = np.frombuffer(places, "<i8", len(ids) + 1)[np.asarray(cut.offsets)] // 4
        flat = np.frombuffer(data, "<u4", ends[-1])
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode every row's whole text, append `end_id`, and write the ids in ascending doc_id order.

    Returns the manifest (part, path, n_docs, n_ids), one row per file, in order.
    A null text is empty and has the end id alone; null doc_ids come first; of
    repeated doc_ids the rows are ordered by the hash of the text. Rows are dealt
    by ranges of doc_id, a task writes a file of its own name as it reads, and only
    files of tasks that succeeded get into the manifest.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = word_ids(tokenizer), TaskContext.get().partitionId()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, end = f"part-{part:07d}-{uuid.uuid4().hex}.ids", np.array([end_id], "<u4")
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            file = IdFile(sink)
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES)) + 1
                for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    rows = batch.slice(at, stop - at)
                    encoded = own.encode(utf8(rows.column(1)))
                    for doc_id, ids in zip(rows.column(0).to_pylist(), encoded):
                        file.add(doc_id, np.append(ids, end))
            n_ids = file.close()
        row = {"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(file.documents)], "n_ids": [n_ids]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema(
            [("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
        ))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return kept(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): what the files hold; `start` counts the ids of all documents before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = filesystem(path)
                with store.open_input_file(place) as source:
                    rows: list[tuple] = []
                    size = 0
                    for doc_id, ids in read_id_file(source):
                        data = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, data))
                        start += len(ids)
                        size += len(data)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    parts = max(files.count(), 1)
    dealt = files.select("path", "first").repartition(parts, "path")
    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")
