"""Passages of benchmark items in documents, in built-in expressions only.

Windows as long as an item are laid where a document shares a five-word shingle
with it: nothing else can be similar. Each window and item gets a SimHash of its
words: 64 counters, four to a long, so that sixteen plain sums make them. Windows
are held against items of their length through a multi-index: fingerprints within
a Hamming distance of 23 agree, in one of eight blocks of eight bits at least, but
for two bits, and items list all such values. Candidates within the distance are
verified by the exact similarity of their weighted shingles, the weight of a
shingle being how often it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let
from folioflow.operators.skew import is_small
from folioflow.session import kept

WIDTH = 5
PERCENT = 80
# At a similarity of 0.8 the words differ by so little that 23 of 64 bits lie more than five
# standard deviations above what is expected.
RADIUS, BLOCKS = 23, 8
LANES = 16
# Above this many words a counter of a fingerprint could overflow: such items are verified without one.
MAX_COUNTED = 65_535


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits. Null has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(cut: Column) -> Column:
    """Hashes of all five neighbouring words, in order."""

    def of(hashes: Column) -> Column:
        last = F.size(hashes) - WIDTH
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))
        )

    return let(F.transform(cut, lambda w: F.xxhash64(w)), of)


def fingerprints(passages: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `bits`, the SimHash, to passages (keys, cut)."""
    each = passages.select(*keys, F.size("cut").alias("_n"), F.explode("cut").alias("_w")).withColumn("_h", F.xxhash64("_w"))
    ones = sum(1 << 64 // 4 * lane for lane in range(4))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(ones))).alias(f"_s{k}") for k in range(LANES)]
    counted = each.groupBy(*keys, "_n").agg(*sums)

    def bit(k: int, lane: int) -> Column:
        count = F.shiftrightunsigned(f"_s{k}", LANES * lane).bitwiseAND(F.lit(MAX_COUNTED))
        return F.shiftleft((2 * count > F.col("_n")).cast("long"), k + LANES * lane)

    bits = [reduce(lambda a, b: a.bitwiseOR(b), [bit(k, lane) for lane in range(4)]) for k in range(LANES)]
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("bits"))


def _block(bits: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, block * 8).bitwiseAND(F.lit(255))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): a row for each document and item it holds, at its most similar place.

    `start` counts words; it is negative where the passage is cut by the document's
    beginning. Texts are compared as lower-case runs of letters and digits. Null and
    empty texts, and items of fewer than five words, match nothing; rows without a
    doc_id or item_id are left out of the pairs; of rows that share a doc_id, or
    item_id, any can give the pair. Other columns are not read.
    """
    numbered = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("cut"))
    items = kept(numbered.filter(F.size("cut") >= WIDTH).withColumn("item", F.xxhash64("item_id", "cut")).dropDuplicates(["item"]).withColumn("long", F.size("cut")))
    places = kept(items.select("item", "long", F.posexplode(shingle_hashes(F.col("cut"))).alias("q", "h")))
    starts = places.groupBy("h").agg(F.collect_set(F.struct("long", "q")).alias("at"))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("words"))
    if is_small(starts.select("h", F.to_json("at").alias("at"))):
        # The words stay where they are: only matches leave the scan's stage, cut to their windows.
        spread = rows.select("doc_id", "row", "words", F.posexplode(shingle_hashes(F.col("words"))).alias("p", "h"))
        met = spread.join(F.broadcast(starts), "h").select("doc_id", "row", "words", F.col("p"), F.explode("at").alias("s"))
    else:
        spread = rows.select("doc_id", "row", F.posexplode(shingle_hashes(F.col("words"))).alias("p", "h"))
        near = spread.join(starts, "h").select("row", "p", F.explode("at").alias("s")).distinct()
        met = rows.dropDuplicates(["row"]).join(near, "row").select("doc_id", "row", "words", "p", "s")
    first = F.col("p") - F.col("s.q")
    cut = F.slice("words", F.greatest(first, F.lit(0)) + 1, F.col("s.long") + F.least(first, F.lit(0)))
    windows = kept(
        met.select("doc_id", "row", F.col("s.long").alias("long"), first.alias("start"), cut.alias("cut"))
        .groupBy("doc_id", "row", "long", "start").agg(F.first("cut").alias("cut"))
    )
    key = ["doc_id", "row", "long", "start"]
    counted = fingerprints(windows.filter(F.col("long") <= MAX_COUNTED), key)
    listed = fingerprints(items.filter(F.col("long") <= MAX_COUNTED), ["item", "long"])
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    asked = counted.withColumn("block", block).withColumn("value", _block(F.col("bits"), F.col("block")))
    near = lambda v: F.bit_count(v.bitwiseXOR(_block(F.col("theirs"), F.col("block")))) <= RADIUS // BLOCKS
    values = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), near)
    index = listed.withColumnRenamed("bits", "theirs").withColumn("block", block).withColumn("value", F.explode(values))
    close = asked.join(index, ["long", "block", "value"]).filter(F.bit_count(F.col("bits").bitwiseXOR(F.col("theirs"))) <= RADIUS)
    candidates = close.select(*key, "item").distinct()
    uncounted = windows.filter(F.col("long") > MAX_COUNTED).join(items.select("item", "long"), "long").select(*key, "item")
    candidates = candidates.unionByName(uncounted)

    theirs = places.groupBy("item", "long", "h").agg(F.count("*").alias("n2"))
    parts = windows.select(*key, F.explode(shingle_hashes(F.col("cut"))).alias("h"))
    ours = parts.groupBy(*key, "h").agg(F.count("*").alias("n1"))
    total = windows.select(*key, F.greatest(F.size("cut") - WIDTH + 1, F.lit(0)).alias("n"))
    shared = (
        candidates.join(ours, key).join(theirs, ["item", "long", "h"])
        .groupBy(*key, "item").agg(F.sum(F.least("n1", "n2")).alias("both"))
        .join(total, key)
        .withColumn("either", F.col("n") + F.col("long") - WIDTH + 1 - F.col("both"))
        .filter(100 * F.col("both") >= PERCENT * F.col("either"))
        .join(items.select("item", "item_id"), "item")
    )
    best = F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("place"))).alias("best")
    return shared.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.place")).cast("long").alias("start"), "best.similarity"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage, with all their columns; rows without a doc_id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
