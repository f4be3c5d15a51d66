"""Set-similarity join of word n-grams by T-occurrence search, and its components.

Two sets are linked from a Jaccard similarity of `percent` / 100 on. A linked pair
shares one of the few first shingles (n - ceil(n * percent / 100) + 1) of each of
its sets in any order common to all sets; here rare shingles come first, by counts
over all documents in a table of fixed size. Documents that share such a shingle
and are near in size are candidates; those that share one with the same smallest
document make a group, so a group is a shingle's documents and not a whole web.
A member stays in its group only if another one may be linked with it by their
bitmaps: parities of shingles by hash, two to four bits a shingle, which differ in
at most as many places as the sets differ in shingles. That loses no link, and
texts travel only to groups where something may be found.

Within a group of candidates the links are found by T-occurrence search:
the sets' inverted lists are kept in order, a query needs T common shingles with
any linked set, its longest L lists are put aside, the short ones are merged with
a heap, and only ids that come T - L times are probed for in the long lists by
binary search (DivideSkip). As components are wanted, a query passes over sets
that are connected with it already. Sets that are equal are one.

Groups of more than `block_docs` sets or `block_shingles` shingles are cut into blocks: blocks are searched on
their own, then the blocks' components by one set each, and last every set that is
not in its group's largest component is a query to all blocks of its group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from heapq import merge
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.rows import WordHashes, keyed, mixed, signed, utf8, window_hashes
from folioflow.session import kept

COUNTERS = 1 << 18
BLOCK_DOCS = 1000
# Shingles of a block, on average: a task holds one block's sets and their lists, about 60 bytes a shingle.
BLOCK_SHINGLES = 1_000_000
# Weight of a binary search against a step of the merge, for the number of long lists.
PROBE_WEIGHT = 0.01
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(words: WordHashes, text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word n-grams; a shorter text is one."""
    cut = text.translate(LOWER).split()
    if not cut:
        return np.zeros(0, np.uint64)
    if len(cut) < width:
        return mixed(window_hashes(words.of(cut), len(cut)) + np.uint64(len(cut)))
    return np.unique(window_hashes(words.of(cut), width))


def overlap_needed(total: int, percent: int) -> int:
    """Least overlap of two linked sets with `total` elements together."""
    return -(-percent * total // (100 + percent))


class Inverted:
    """Inverted lists of numbered sets, as slices of one array; sets take part once they are added, in the order of their numbers."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(items) for items in sets], np.int64)
        ends = np.cumsum(self.sizes)
        items, lists = np.unique(np.concatenate(sets), return_inverse=True)
        self.lists = [lists[end - size : end].astype(np.int32) for end, size in zip(ends, self.sizes)]
        # Entries of a list lie side by side, by number.
        order = np.argsort(lists, kind="stable")
        self.entries = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.starts = np.searchsorted(lists[order], np.arange(len(items)))
        self.filled = np.zeros(len(items), np.int32)
        self.least = 1 << 62

    def add(self, number: int) -> None:
        self.filled[self.lists[number]] += 1
        self.least = min(self.least, int(self.sizes[number]))

    def search(self, query: int, percent: int, wanted: Callable[[int], bool]) -> Iterator[int]:
        """Numbers of the sets linked with set `query`, those that are `wanted` when they come up."""
        lists = self.lists[query]
        size = len(lists)
        need = overlap_needed(size + max(self.least, -(-percent * size // 100)), percent)
        lengths = self.filled[lists]
        found = lists[lengths > 0]
        if len(found) < need:
            return
        found = found[np.argsort(self.filled[found], kind="stable")]
        starts, lengths = self.starts[found], self.filled[found]
        long = min(int(need / (PROBE_WEIGHT * log2(int(lengths[-1]) + 1) + 1)), need - 1)
        cut = len(found) - long
        short = [self.entries[a : a + n].tolist() for a, n in zip(starts[:cut].tolist(), lengths[:cut].tolist())]
        rest = [(a, a + n) for a, n in zip(starts[cut:].tolist(), lengths[cut:].tolist())]
        enough = need - long
        last, times = -1, 0
        for number in merge(*short, [1 << 62]):
            if number == last:
                times += 1
                continue
            if times >= enough and wanted(last) and self._linked(last, times, size, rest, percent):
                yield last
            last, times = number, 1

    def _linked(self, number: int, times: int, size: int, rest: list[tuple[int, int]], percent: int) -> bool:
        need = overlap_needed(size + int(self.sizes[number]), percent)
        left = len(rest)
        for start, end in rest:
            if times >= need or times + left < need:
                break
            left -= 1
            at = bisect_left(self.entries, number, start, end)
            times += at < end and self.entries[at] == number
        return times >= need


def search_links(sets: Iterable[tuple[bool, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked, from (query, id, label, set).

    Sets of one label are known to be connected. Every query is held against all
    sets before it; sets that aren't queries come first and are only held against.
    A query passes over sets that are connected with it already, and ends when all are.
    """
    sets = sorted(sets, key=lambda s: (s[0], s[1]))
    links: list[tuple[int, int]] = []
    index = Inverted([items for *_, items in sets])
    home: dict[int, int] = {}
    apart = 0  # components in the index

    def root(label: int) -> int:
        while home[label] != label:
            home[label] = home[home[label]]
            label = home[label]
        return label

    for place, (query, doc_id, label, _) in enumerate(sets):
        if label not in home:
            home[label] = label
            apart += 1
        if query and apart > 1:
            for number in index.search(place, percent, lambda n: root(sets[n][2]) != root(label)):
                links.append((doc_id, sets[number][1]))
                home[root(sets[number][2])] = root(label)
                apart -= 1
                if apart == 1:
                    break
        index.add(place)
    return links


def _counter_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                places = shingles(words, text, width) & np.uint64(COUNTERS - 1)
                counts += np.bincount(places.astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], ["counts"])

    return run


def _sum_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            total += np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])


def shingle_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle, by its hash's low bits: 262,144 counters over all rows.

    Tasks count, their tables are summed a few dozen at a time, and the driver gets those sums.
    """
    partial = rows.select("text").mapInArrow(_counter_rows(width), "counts binary")
    parts = partial.repartition(8).mapInArrow(_sum_counters, "counts binary").collect()
    return sum((np.frombuffer(r["counts"], np.int64) for r in parts), np.zeros(COUNTERS, np.int64))


def prefix(items: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare ones first: linked sets share one of them."""
    length = len(items) - -(-percent * len(items) // 100) + 1
    order = rarity[items & np.uint64(COUNTERS - 1)] << np.uint64(24) | mixed(items) >> np.uint64(40)
    return items[np.argpartition(order, length - 1)[:length]] if length < len(items) else items


def bitmap(items: np.ndarray) -> bytes:
    """The parity of the set's shingles by their hash's low bits: a power of two of bits, twice the set's size at least."""
    bits = max(128, 1 << (2 * len(items) - 1).bit_length()) if len(items) else 128
    counts = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def may_link(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """Which sets another one here may be linked with: all that are linked, and rarely one that isn't.

    Larger bitmaps are folded to the size of the smallest; sets differ in at least as many shingles as bits.
    """
    words = min(map(len, bitmaps)) // 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in bitmaps])
    near = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        others = np.arange(i + 1, len(sizes))
        if near[i]:
            others = others[~near[i + 1 :]]
        if len(others):
            totals = sizes[others] + sizes[i]
            apart = np.bitwise_count(folded[others] ^ folded[i]).sum(axis=1, dtype=np.int64)
            found = others[apart <= totals - 2 * -(-percent * totals // (100 + percent))]
            near[found] = True
            near[i] |= len(found) > 0
    return near


SETS = "kind long, doc_id long, x long, y long, n long, bitmap binary"


def _set_rows(width: int, percent: int, rarity: np.ndarray):
    """Per document its size, set's digest and bitmap (kind 0), and its prefix's shingles (kind 1: x), all with the size n."""
    names = ["kind", "doc_id", "x", "y", "n", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                parts: list[list[np.ndarray]] = []
                bitmaps: list[bytes | None] = []
                for doc_id, text in zip(rows.column(0).to_pylist(), utf8(rows.column(1))):
                    items = shingles(words, text, width)
                    digests = [np.bitwise_xor.reduce(mixed(items + np.uint64(k)), initial=0) for k in (1, 2)]
                    first = prefix(items, rarity, percent) if len(items) else items
                    kind = np.ones(len(first) + 1, np.int64)
                    kind[0] = 0
                    x = signed(np.append(np.uint64(digests[0]), first))
                    y = np.zeros(len(kind), np.int64)
                    y[0] = np.uint64(digests[1]).view(np.int64)
                    parts.append([kind, kind * 0 + doc_id, x, y, kind * 0 + len(items)])
                    bitmaps += [bitmap(items), *[None] * len(first)]
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bitmaps, pa.binary())], names)

    return run


def _near_rows(percent: int):
    """(group, doc_id) of the members that may be linked within their group; rows (group, doc_id, n, bitmap) come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []

        def finish(found: list[tuple[int, int]]) -> None:
            if len(rows) > 1:
                ids, sizes, bitmaps = zip(*rows)
                near = may_link(np.array(sizes, np.int64), list(bitmaps), percent)
                found.extend((place, i) for i in sorted({i for i, n in zip(ids, near.tolist()) if n}))

        def told(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["group", "doc_id"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != place:
                    finish(found)
                    place, rows = group, []
                rows.append(row)
            yield from told(found)
        found = []
        finish(found)
        yield from told(found)

    return run


def _search_rows(width: int, percent: int):
    """Links (a, b) of each (group, part); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place, sets = WordHashes(), None, []

        def finish() -> Iterator[pa.RecordBatch]:
            links = search_links(sets, percent) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for group, part, query, doc_id, label, text in zip(*columns, utf8(batch.column(5))):
                if (group, part) != place:
                    yield from finish()
                    place, sets = (group, part), []
                sets.append((query, doc_id, label, shingles(words, text, width)))
        yield from finish()

    return run


def _links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    rows = members.join(texts, "doc_id").select("group", "part", "query", "doc_id", "label", "text")
    dealt = rows.repartition("group", "part").sortWithinPartitions("group", "part")
    return dealt.mapInArrow(_search_rows(width, percent), "a long, b long")


def _members(rows: DataFrame, part: Column, query: Column | bool = True, label: Column | str = "doc_id") -> DataFrame:
    label = F.col(label) if isinstance(label, str) else label
    query = F.lit(query) if isinstance(query, bool) else query
    return rows.select("group", part.cast("long").alias("part"), query.alias("query"), "doc_id", label.alias("label"))


def _large_groups(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within groups of more than a block; members has (group, doc_id, blocks, block_docs)."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    links = kept(_links(_members(placed, F.col("block")), texts, width, percent))

    def labelled(found: DataFrame) -> DataFrame:
        told = components(found).withColumnRenamed("id", "doc_id")
        return kept(placed.join(told, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component"))

    # The blocks' components, by their smallest set, as long as a round joins some of them.
    state = labelled(links)
    before = None
    while True:
        heads = state.filter("doc_id = label").withColumn("n", F.count("*").over(Window.partitionBy("group")))
        count = heads.count()
        if count == before or heads.filter("n > 1").isEmpty():
            break
        before = count
        part = F.pmod(F.xxhash64("doc_id", F.lit(count)), F.ceil(F.col("n") / F.col("block_docs")))
        links = kept(links.unionByName(_links(_members(heads.filter("n > 1"), part), texts, width, percent)))
        state = labelled(links)
    sizes = state.groupBy("group", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels"))
    apart = state.join(largest.filter("labels > 1").select("group", F.col("m.label").alias("main")), "group")
    rest = apart.filter("label <> main")
    counts = rest.groupBy("group").agg(F.ceil(F.count("*") / F.first("block_docs")).alias("askers"))
    queries = rest.join(counts, "group").withColumn("asker", F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.col("askers")))
    against = apart.join(counts, "group")
    index = against.withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = _members(asked, F.col("asker") * F.col("blocks") + F.col("block"), True, "label").unionByName(
        _members(index, F.col("asker") * F.col("blocks") + F.col("block"), False, "label")
    )
    return links.unionByName(_links(both, texts, width, percent))


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links.

    A-Z are put into lower case; words are runs of anything but the six ASCII
    spaces. A text of fewer than `width` words is one shingle; null, empty and blank
    texts have none and are linked with nothing. Rows without a doc_id come out
    with a null component. Rows that share a doc_id are one node of the links, so
    they have one component; each has its own n_shingles. Columns other than doc_id
    and text are not read.
    """
    rows = keyed(docs, "doc_id", "text")
    counts = shingle_counts(rows, width)
    rarity = counts.astype(np.uint64)
    sets = kept(rows.mapInArrow(_set_rows(width, percent, rarity), SETS))
    each = sets.filter("kind = 0").select("doc_id", "x", "y", "n")
    firsts = each.filter("n > 0").groupBy("x", "y", "n").agg(F.min("doc_id").alias("first"))
    # Documents with equal sets are linked to the smallest of them, which stands for all.
    equal = kept(each.join(firsts, ["x", "y", "n"]).select("doc_id", "first").distinct())

    shared = sets.filter("kind = 1").select(F.col("x").alias("shingle"), "doc_id", "n")
    often = shared.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    # Linked sizes differ by less than one step of a scale: sets of a step and the next one meet.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent) * 1.0001)).cast("long")
    met = shared.join(often.select("shingle"), "shingle", "left_semi").join(equal.filter("doc_id = first").select("doc_id"), "doc_id", "left_semi")
    met = kept(met.select("shingle", F.explode(F.array(step, step - 1)).alias("step"), "doc_id", "n"))
    heads = met.groupBy("shingle", "step").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("m")).filter("head < m")
    # Whoever shares a shingle shares its smallest document: that one's sharers are a group.
    groups = met.join(heads, ["shingle", "step"]).groupBy(F.xxhash64("head", "step").alias("group"), "doc_id").agg(F.max("n").alias("n"))
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles))
    sizes = groups.groupBy("group").agg(blocks.alias("blocks"), F.count("*").alias("_docs"))
    sizes = sizes.select("group", "blocks", F.greatest(F.lit(1), F.floor(F.col("_docs") / F.col("blocks"))).alias("block_docs"))
    members = kept(groups.drop("n").join(sizes, "group"))

    bitmaps = sets.filter("kind = 0 and n > 0").select("doc_id", "n", "bitmap")
    small = members.filter("blocks = 1").join(bitmaps, "doc_id").select("group", "doc_id", "n", "bitmap")
    near = small.repartition("group").sortWithinPartitions("group").mapInArrow(_near_rows(percent), "group long, doc_id long")
    links = _links(_members(near, F.lit(0)), rows, width, percent)
    if not members.filter("blocks > 1").isEmpty():
        links = links.unionByName(_large_groups(members.filter("blocks > 1"), rows, width, percent))
    found = components(links).select(F.col("id").alias("first"), "component")
    placed = equal.join(found, "first", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component"))
    told = each.join(placed, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    unkeyed = docs.filter(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), "text")
    sizes = unkeyed.mapInArrow(_set_rows(width, percent, rarity), SETS).filter("kind = 0")
    none = F.lit(None).cast("long")
    return told.unionByName(sizes.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))
