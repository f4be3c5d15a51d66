"""Joins and running totals that hold up when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import kept

# Above this many rows a key is split; only this many keys can be split, so the
# list of them is small enough to broadcast whatever the data. A key outside the
# list holds at most 1/MAX_HOT_KEYS of all rows.
ROWS_PER_SALT = 200_000
MAX_HOT_KEYS = 512
MAX_SALTS = 4096
# Largest group that one window task is given.
MAX_WINDOW_ROWS = 1_000_000
# Largest lookup table that is broadcast, in rows and in bytes of text.
MAX_LOOKUP_ROWS = 50_000
MAX_LOOKUP_BYTES = 64 * 1024 * 1024


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, stored: for several decisions about a table that is costly to derive."""
    return kept(df.groupBy(*keys).agg(F.count("*").alias("_rows")))


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT, counts: DataFrame | None = None
) -> DataFrame:
    """The most frequent keys above the threshold, with the number of pieces to split each into."""
    pieces = F.least(F.ceil(F.col("_rows") / rows_per_salt), F.lit(MAX_SALTS)).cast("int")
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return (
        counts.filter(F.col("_rows") > rows_per_salt)
        .orderBy(F.desc("_rows"))
        .limit(MAX_HOT_KEYS)
        .select(*keys, pieces.alias("_pieces"))
    )


def skew_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT,
    redistribute: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join `many` (may have hot keys) with `one` (one row per key).

    Rows of a hot key are spread over salts by the columns `spread_by`; the
    matching row of `one` is repeated once per salt. Other keys are untouched.
    With `redistribute`, the rows are partitioned by key first even if the join
    then broadcasts: for costly work per row afterwards. A shuffled join reuses
    that partitioning. `counts` are the `key_counts` of `many`, if there are any.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    hot = F.broadcast(hot_keys(many, on, rows_per_salt, counts))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    spread = F.pmod(F.xxhash64(*spread_by), pieces.cast("long")).cast("int")
    left = many.join(hot, list(on), "left").withColumn("_salt", spread).drop("_pieces")
    if redistribute:
        left = left.repartition(*on, "_salt")
    right = one.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right.drop("_pieces"), [*on, "_salt"], how).drop("_salt")


def is_small(table: DataFrame) -> bool:
    """Whether a table is measured to fit a broadcast; counting stops just above the limit."""
    texts = [F.octet_length(F.col(c).cast("string")) for c in table.columns]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0).cast("long"))
    rows, measured = table.limit(MAX_LOOKUP_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= MAX_LOOKUP_ROWS and measured <= MAX_LOOKUP_BYTES


def lookup_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str]
) -> DataFrame:
    """Join with a catalogue: broadcast if it is measured to be small, salted otherwise."""
    if is_small(table):
        return rows.join(F.broadcast(table), list(on), how)
    return skew_join(rows, table, on, how, spread_by)


def only_named(table: DataFrame, named: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a wide table whose key is named, without a shuffle, if few keys are.

    Where many are, the table is returned whole: the join that follows finds the
    rows, and a second shuffle would save nothing.
    """
    keys = named.select(*on).distinct()
    if not is_small(keys):
        return table
    return table.join(F.broadcast(keys), list(on), "left_semi")


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    totals: dict[str, str],
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add running sums (this row included) of columns, per group in order.

    `totals` maps each new column to the column it sums. While the largest
    group fits a window task, that is a plain window. Otherwise the rows are
    sorted over the whole cluster and kept in reliable storage with the number
    of their block, each block is summed on its own, and the sums of the blocks
    before it are added: no task sees more than one block. `order` must name each
    row of a group uniquely, and `df` should hold narrow columns only.
    """
    limit = MAX_WINDOW_ROWS if max_group_rows is None else max_group_rows
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    upto_here = Window.unboundedPreceding, Window.currentRow
    if largest <= limit:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(*upto_here)
        return df.withColumns({new: F.sum(old).over(window) for new, old in totals.items()})

    blocks = kept(df.orderBy(*group, *order).withColumn("_block", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(*group, "_block")
        .agg(*[F.sum(old).alias(f"_sum_{new}") for new, old in totals.items()])
        .select(
            *group,
            "_block",
            *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_before_{new}") for new in totals],
        )
    )
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(*upto_here)
    return (
        blocks.join(offsets, [*group, "_block"])
        .withColumns({new: F.sum(old).over(inside) + F.col(f"_before_{new}") for new, old in totals.items()})
        .drop("_block", *[f"_before_{new}" for new in totals])
    )


def running_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, max_group_rows: int | None = None
) -> DataFrame:
    """Add a 1-based position per group."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(counted, group, order, {name: "_one"}, max_group_rows).drop("_one")
