"""Debounce, rescans, extraction and superseding results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import sha1_content
from folioflow.operators.extraction import extract_changes
from folioflow.operators.selection import KEY
from folioflow.session import kept
from folioflow.sources.tables import read_latest, snapshot
from folioflow.sources.versionlog import VersionLog

EXTRACTED = ("hunks", "suggestions", "rejects", "errors")
EPOCHS = "_epochs"


def debounce_stream(events: DataFrame, key: str, ts: str, payload: str, gap: str, lateness: str | None = None) -> DataFrame:
    """The last event of every burst: one row once a key has been quiet for `gap`.

    Events that arrive later than `lateness` are dropped with the watermark.
    """
    last = F.max(F.struct(ts, payload)).alias("_last")
    settled = events.withWatermark(ts, lateness or gap).groupBy(key, F.session_window(ts, gap)).agg(
        last, F.count("*").alias("n_events")
    )
    return settled.select(key, f"_last.{ts}", f"_last.{payload}", "n_events")


def _micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch, by the clock of the column, whatever the session's zone."""
    zoned = isinstance(events.schema[ts].dataType, T.TimestampType)
    epoch = F.expr("timestamp_ltz'1970-01-01 00:00:00Z'" if zoned else "timestamp_ntz'1970-01-01 00:00:00'")
    seconds = (F.col(ts) - epoch).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")


def debounce(events: DataFrame, key: str, ts: str, payload: str, gap_us: int) -> DataFrame:
    """The same over a finished table, for keys with any number of events.

    Time is cut into cells as long as the gap. Only the last event of a cell can
    end a burst, and only the next cell can hold an event soon enough to go on
    with it; so each cell is summed up in the aggregate and meets one neighbour.
    """
    micros = _micros(events, ts)
    cell = F.floor(micros / F.lit(gap_us)).cast("long")
    cells = events.select(key, ts, payload, cell.alias("_cell"), micros.alias("_us")).groupBy(key, "_cell").agg(
        F.max(F.struct(ts, payload)).alias("_last"), F.max("_us").alias("_latest"), F.min("_us").alias("_earliest")
    )
    following = cells.select(key, (F.col("_cell") - 1).alias("_cell"), F.col("_earliest").alias("_next"))
    goes_on = F.coalesce(F.col("_next") - F.col("_latest") <= gap_us, F.lit(False))
    return cells.join(following, [key, "_cell"], "left").filter(~goes_on).select(key, f"_last.{ts}", f"_last.{payload}")


def scan_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that a rescan added, removed or changed, by checksum."""
    old = before.select(*KEY, sha1_content(F.col("content")).alias("_old"))
    new = after.select(*KEY, sha1_content(F.col("content")).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    )
    return old.join(new, KEY, "full").select(*KEY, change.alias("change")).filter(F.col("change").isNotNull())


def incremental_scan(versions: DataFrame, path: str, checkpoint: str, ts: str = "seen_at") -> StreamingQuery:
    """Append file versions to a snapshot table; `read_latest(spark, path, ts)` reads the newest of each file.

    The newest is the one of the latest time, however late it came; of one time, the
    one that came last. Only a row with the time and checksum of the newest so far
    is left out, so contents that come back, or come late, count. A micro-batch
    writes the version of its own number and looks at lower ones, so a replay replaces it.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*KEY).agg(F.max(ts).alias(ts), F.max_by("content", ts).alias("content"))
        fresh = snapshot(newest, batch_id, ts)
        if batch_id:
            earlier = read_latest(batch.sparkSession, path, ts, batch_id).select(*KEY, "sha1", ts)
            fresh = fresh.join(earlier, [*KEY, "sha1", ts], "left_anti").select(fresh.columns)
            # The table is read and written: dynamic overwrite replaces this version's folder only.
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "version"
        ).parquet(path)

    return versions.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_extract(responses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Extract changes from each micro-batch of responses into the tables EXTRACTED under `path`.

    A batch's record is made after all of its tables are written, and only what has
    a record is read (`read_extracted`): hunks, suggestions, rejects and errors of a
    batch become visible together. A replay replaces a batch without a record, and
    leaves one with a record alone. One stream may write to a path; a batch that
    a stream with another checkpoint has written is an error.
    """
    epochs = VersionLog(responses.sparkSession, f"{path}/{EPOCHS}")

    def publish(batch: DataFrame, batch_id: int) -> None:
        known = epochs.line(batch_id)
        if known is not None:
            if json.loads(known)["checkpoint"] != checkpoint:
                raise ValueError(f"another stream has written batch {batch_id} of {path}")
            return
        found = extract_changes(batch, keep=kept)
        schemas = {}
        for name in EXTRACTED:
            rows = getattr(found, name).withColumn("batch_id", F.lit(batch_id).cast("long"))
            schemas[name] = rows.schema.jsonValue()
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")
        epochs.put(batch_id, json.dumps({"checkpoint": checkpoint, "schemas": schemas}))

    return responses.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_extracted(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables EXTRACTED that `stream_extract` writes: whole batches only, with their `batch_id`.

    Batches are written one after another, so those up to the last record are whole.
    A table without rows is empty; a path without any record is an error.
    """
    epochs = VersionLog(spark, f"{path}/{EPOCHS}")
    last = epochs.last()
    if last is None:
        raise ValueError(f"no batch of {path} is whole yet")
    schema = T.StructType.fromJson(json.loads(epochs.line(last))["schemas"][name])
    return spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("batch_id") <= last)


def supersede(results: DataFrame, key: Sequence[str], generation: str, payload: str) -> DataFrame:
    """The result of the newest task per key; results of replaced tasks are ignored."""
    newest = results.groupBy(*key).agg(F.max(F.struct(generation, payload)).alias("_newest"))
    return newest.select(*key, f"_newest.{generation}", f"_newest.{payload}")


def supersede_stream(results: DataFrame, key: Sequence[str], generation: str, payload: str) -> DataFrame:
    """The same on a stream, for the update output mode; state is one row per key."""
    return supersede(results, key, generation, payload)
