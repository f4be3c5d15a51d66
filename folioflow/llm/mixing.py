"""Mixing sources to target weights by a low-discrepancy schedule, in built-in expressions only.

Every source is a stream of words: its documents one after another, shuffled by a
hash, cut into blocks of equal length. The schedule deals slots to sources by the
van der Corput sequence: slot i lies at the point whose binary digits are those of i
backwards, and belongs to the source whose share of the cumulated weights holds the
point. The slots of a source, ranked, take its blocks one after another, from the
first one again when all are used, and the last slot takes only what its target lacks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.quality import words
from folioflow.session import kept

# Words of a block.
BLOCK_WORDS = 4096
# Documents that one task orders, on average; slots that one task ranks, at most.
DOCS_TOGETHER = 20_000
SLOT_BITS = 14
SOURCE = ["_none", "_source"]


@dataclass(frozen=True)
class Mix:
    """Weights by rank of the source (repeating), words in all as a share of what there is, and how often a source may be used."""

    weights: Sequence[int] = (3, 1, 2)
    share: tuple[int, int] = (3, 2)
    repeats: int = 2
    block_words: int = BLOCK_WORDS


def _before(rows: DataFrame, group: list[str], block: str, order: list[str], value: str, name: str, extra: DataFrame | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows of the group that come before a row.

    Blocks are consecutive stretches of that order, so a window sees one block's rows,
    or one group's blocks, whatever the size of a group. `extra` has a row per group.
    """
    sums = rows.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if extra is not None:
        offsets = offsets.join(extra, group)
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, [*group, block]).withColumn(name, F.col("_in") + F.col("_off")).drop("_in", "_off", block)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, _none, _source, size, _h) of every document, stored: narrow rows for all that follows."""
    source = F.col("source").cast("string")
    return kept(docs.select(
        "doc_id", source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"),
        F.size(words(F.col("text").cast("string"))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"),
    ))


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """Per source: source_size, target, _take (the target in whole words), stored.

    The excess of sources whose share is above their limit goes to the others by
    weight, until none is above; per round two sums come to the driver.
    """
    found = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    # One row per source: their order by code point gives the weights.
    rank = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weight = F.get(F.array(*[F.lit(int(w)).cast("long") for w in mix.weights]), rank % len(mix.weights))
    sources = kept(found.withColumn("_weight", weight))
    up, down = mix.share
    exact = "decimal(38,0)"
    cap = (F.col("source_size") * mix.repeats).cast(exact)

    def above(rest: int, weights: int) -> Column:
        # weight * rest / (down * weights) > cap, in whole numbers.
        return F.col("_weight") * F.lit(rest).cast(exact) > cap * F.lit(down * weights).cast(exact)

    total, weights = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    total, weights = total or 0, weights or 0
    rest, left, fixed = up * total, weights, None
    while left:
        over = above(rest, left)
        count, capped, heavy = sources.filter(over).agg(F.count("*"), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
        if count == fixed:
            break
        fixed, rest, left = count, up * total - down * int(capped), weights - heavy
    over = above(rest, left) if left else F.lit(True)
    shared = (F.col("_weight") * F.lit(rest)).cast("double") / F.lit(down * max(left, 1))
    target = F.when(over, cap.cast("double")).otherwise(shared)
    return kept(sources.withColumn("target", target).withColumn("_take", F.floor(F.col("target") + 0.5)))


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """(slot, source, rank, block, words): the schedule; slots are in order, with gaps where a point is beyond all weights."""
    size, take, block = F.col("source_size"), F.col("_take"), mix.block_words
    blocks = F.ceil(size / block)
    whole = F.when(size > 0, F.floor(take / size)).otherwise(0)
    need = (whole * blocks + F.when(size > 0, F.ceil((take - whole * size) / block)).otherwise(0)).cast("long")
    upto = Window.orderBy(*SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    shares = kept(sources.select(*SOURCE, "source_size", "_take", need.alias("_need")).withColumn("_from", F.coalesce(F.sum("_need").over(upto), F.lit(0))))
    total = shares.agg(F.sum("_need")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    # Points of a source lie side by side; they are listed in two steps, so that no row gets long.
    step = 1 << SLOT_BITS
    chunks = shares.filter("_need > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_need - 1) div {step}"))))
    point = F.explode(F.sequence(F.col("_from") + F.col("_c") * step, F.col("_from") + F.least((F.col("_c") + 1) * step, F.col("_need")) - 1))
    points = chunks.repartition(1 + total // (64 * step), *SOURCE, "_c").select(*SOURCE, "source_size", "_take", point.alias("_point"))
    backwards = F.conv(F.reverse(F.lpad(F.bin("_point"), bits, "0")), 2, 10).cast("long")
    dealt = points.withColumn("slot", backwards).withColumns({"_b": F.shiftright("slot", SLOT_BITS), "_one": F.lit(1).cast("long")})
    ranked = _before(dealt, SOURCE, "_b", ["slot"], "_one", "rank").drop("_one")
    blocks, number = F.ceil(size / block).cast("long"), F.expr("rank % _blocks")
    # Words of the stream that come before this slot's, counted over all rounds.
    ahead = F.expr(f"rank div _blocks * source_size + rank % _blocks * {block}")
    length = F.least(F.lit(block), size - number * block, take - ahead)
    return ranked.withColumn("_blocks", blocks).select(
        *SOURCE, "slot", "rank", number.alias("block"), length.cast("long").alias("words")
    )


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with `start`, the words of its source's stream before it, and its source's columns."""
    count = sized.count()
    parts = 1 + count // DOCS_TOGETHER
    # The leading digits of the hash say which part of the order a row is in.
    part = F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * parts, 32)
    return _before(sized.withColumn("_b", part), SOURCE, "_b", ["_h", "size"], "size", "start", sources)


def pieces(laid: DataFrame, dealt: DataFrame, mix: Mix) -> DataFrame:
    """The part of each document with words in each block of its stream, once for each slot that takes it, if any."""
    block = mix.block_words
    numbers = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    cut = laid.filter("size > 0").withColumn("block", F.explode(numbers))
    first, stop = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    met = cut.join(dealt, [*SOURCE, "block"], "left")
    taken = F.greatest(F.lit(0), F.least(stop, F.col("block") * block + F.col("words")) - first)
    n = F.when(F.col("words").isNotNull(), taken).otherwise(0).cast("long")
    return met.withColumns({"first_word": first - F.col("start"), "place": first - F.col("block") * block, "n": n})


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as (slot, place, source, doc_id, first_word, n): read by slot and place, `n` words of a document from `first_word` on.

    Handles odd rows as `mix_report` does; documents without words give no rows.
    """
    sized = sizes(docs)
    sources = targets(sized, mix)
    found = pieces(streams(sized, sources), slots(sources, mix), mix).filter("n > 0")
    return found.select("slot", "place", F.when(~F.col("_none"), F.col("_source")).alias("source"), "doc_id", "first_word", "n")


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Words are runs of anything but the six ASCII spaces. Sources are ordered by code
    point, null last, as a source of its own beside the empty one. Null and empty
    texts have size 0 and are not taken; sources without words have target 0. Documents are ordered by
    the MD5 of their doc_id (null as empty), then by size, so reruns agree; rows that
    share doc_id, source and size are interchangeable, each is in the stream once. An
    empty table gives an empty result. Columns other than doc_id, text and source are
    not read. Sources, one row each, are ranked in one task; documents and slots are
    ordered in pieces, however many a source has.
    """
    sized = sizes(docs)
    sources = targets(sized, mix)
    laid = streams(sized, sources)
    out = ["doc_id", "size", "source_size", "target"]
    found = pieces(laid, slots(sources, mix), mix)
    taken = found.groupBy(*SOURCE, "start", *out).agg(F.sum("n").alias("taken")).select(*out, "taken")
    none = laid.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none)
