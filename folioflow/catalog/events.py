"""Queries of debouncing, rescans and superseded results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.changes import REJECTED, UNREADABLE, leaving_responses, paired
from folioflow.catalog.registry import query
from folioflow.session import ensure_checkpoint_dir
from folioflow.sources.tables import read_latest
from folioflow.streaming import (
    debounce, debounce_stream, incremental_scan, read_extracted, scan_changes, stream_extract, supersede, supersede_stream,
)


def _place(spark: SparkSession, name: str) -> str:
    """A new folder for the files of one streaming run, beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(df: DataFrame, place: str, batches: int = 1) -> DataFrame:
    """The rows as a stream of files in so many micro-batches; no task writes or reads more than a file of bounded size."""
    spark, path = df.sparkSession, f"{place}/in"
    df.hint("rebalance").write.parquet(path)
    count = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    if count < batches:
        # All of it is less than a few of those files.
        path = f"{place}/parted"
        spark.read.schema(df.schema).parquet(f"{place}/in").repartition(batches).write.parquet(path)
        count = batches
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-count // batches)).parquet(path)


def _finish(stream: DataFrame, place: str, mode: str) -> DataFrame:
    """Run a stream to its end into a table and read that."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(f"{place}/out")

    query = stream.writeStream.foreachBatch(append).outputMode(mode).option("checkpointLocation", f"{place}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/out")


def _settled(minutes: int) -> str:
    return f"""SELECT user_id, ts, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
WHERE next IS NULL OR next - ts > INTERVAL {minutes} MINUTE"""


@query("debounce", _settled(30))
def debounce_query(spark: SparkSession, folder: str) -> DataFrame:
    return debounce(fx.table(spark, folder, "events"), "user_id", "ts", "event_id", gap_us=30 * 60 * 1_000_000)


@query("debounce_short_gap", _settled(5))
def debounce_short_gap(spark: SparkSession, folder: str) -> DataFrame:
    return debounce(fx.table(spark, folder, "events"), "user_id", "ts", "event_id", gap_us=5 * 60 * 1_000_000)


@query("debounce_sessions", _settled(30))
def debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The plan that runs on streams, over the finished table."""
    return debounce_stream(fx.table(spark, folder, "events"), "user_id", "ts", "event_id", "30 minutes").drop("n_events")


@query("supersede", """
SELECT user_id, event_type, max(event_id) AS event_id, max_by(props, event_id) AS props FROM events GROUP BY user_id, event_type""")
def supersede_query(spark: SparkSession, folder: str) -> DataFrame:
    """An event's number is the generation of its task."""
    return supersede(fx.table(spark, folder, "events"), ["user_id", "event_type"], "event_id", "props")


@query("scan_changes", f"""WITH {q.FILES}
SELECT project_id, rel_path, CASE lang WHEN 'en' THEN 'removed' WHEN 'fr' THEN 'changed' END AS change FROM files WHERE lang IN ('en', 'fr')
UNION ALL SELECT project_id, rel_path || '.new', 'added' FROM files""")
def scan_changes_query(spark: SparkSession, folder: str) -> DataFrame:
    """Between two scans, one language was removed, one edited, and every file got a twin."""
    before = fx.files(spark, folder)
    edited = before.withColumn("content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    twins = before.withColumn("rel_path", F.concat("rel_path", F.lit(".new")))
    return scan_changes(before, edited.filter("lang <> 'en'").union(twins))


@query("debounce_stream", f"""
SELECT user_id, ts, event_id FROM ({_settled(30)}) WHERE ts + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events)""")
def debounce_on_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts on a stream: those that the watermark has passed when the stream ends."""
    place = _place(spark, "debounce")
    events = fx.table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    settled = debounce_stream(_as_stream(events, place), "user_id", "ts", "event_id", "30 minutes")
    return _finish(settled, place, "append").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("supersede_stream", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def supersede_on_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Results in four micro-batches; the table of updates holds each key's newest one last."""
    place = _place(spark, "supersede")
    results = fx.table(spark, folder, "events").select("user_id", "event_id", "event_type")
    updates = _finish(supersede_stream(_as_stream(results, place, 4), ["user_id"], "event_id", "event_type"), place, "update")
    return supersede(updates, ["user_id"], "event_id", "event_type")


@query("incremental_scan", f"""WITH {q.FILES}
SELECT project_id, rel_path, content || chr(10) AS content, sha1(content || chr(10)) AS sha1 FROM files""")
def incremental_scan_query(spark: SparkSession, folder: str) -> DataFrame:
    """Every file is seen twice by two scans in a stream; the table holds it once."""
    place = _place(spark, "scan")
    seen = fx.files(spark, folder).select("project_id", "rel_path", "content", F.timestamp_seconds("mtime_s").alias("seen_at"))
    stream = _as_stream(seen.union(seen), place, 2)
    incremental_scan(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return read_latest(spark, f"{place}/out", "seen_at").select("project_id", "rel_path", "content", "sha1")


@query("stream_extract", f"""WITH {q.HUNKS}
SELECT response_id, project_id, rel_path, array_to_string(hunk_lines, chr(10)) AS body FROM hunks WHERE response_id % 6 IN (0, 1)""")
def stream_extract_query(spark: SparkSession, folder: str) -> DataFrame:
    """Responses in two micro-batches; the hunks are those of one batch job."""
    hunks = _extracted(fx.responses(spark, folder), "hunks")
    return hunks.select("response_id", "project_id", "rel_path", F.array_join("hunk_lines", "\n").alias("body"))


def _extracted(responses: DataFrame, name: str) -> DataFrame:
    """What a stream over the responses, in two micro-batches, leaves in one of its tables."""
    place = _place(responses.sparkSession, "extract")
    stream_extract(_as_stream(responses, place, 2), f"{place}/out", f"{place}/state").awaitTermination()
    return read_extracted(responses.sparkSession, f"{place}/out", name).drop("batch_id")


@query("stream_suggestions", paired("2, 3"))
def stream_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(fx.responses(spark, folder), "suggestions")


@query("stream_rejects", REJECTED)
def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(leaving_responses(spark, folder), "rejects")


@query("stream_errors", UNREADABLE)
def stream_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _extracted(fx.responses(spark, folder), "errors").select("response_id", "project_id")
