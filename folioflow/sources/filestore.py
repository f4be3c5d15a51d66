"""Files in versions: edits and backups of a batch become visible together, or not at all.

Every commit is a folder of Parquet rows and a small record that names it. Spark
commits the folder's files; the record, made only if none of its number is there
yet, makes the version. A batch states the checksum that each of its files had
when it was read. Files that changed since are left out and reported; if another
batch commits first, the check is made again against what it left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.paths import backup_path
from folioflow.functions.text import sha1_content
from folioflow.operators.selection import KEY
from folioflow.session import kept
from folioflow.sources.versionlog import VersionLog

ROWS = "version long, project_id string, rel_path string, backup_path string, content string, sha1 string, kind string"
FILE, BACKUP = "file", "backup"


class FileStore:
    """A folder that the driver and all executors can reach, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._log = VersionLog(spark, f"{self.path}/_versions")

    def versions(self) -> dict[int, str]:
        """The data folder of every version; one short record each."""
        return self._log.all()

    def _record(self, version: int, folder: str) -> bool:
        """Make the record of a version; False if there is one already."""
        return self._log.add(version, folder)

    # ---- reading

    def _rows(self, kind: str, upto: int | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for version, folder in self.versions().items() if upto is None or version <= upto]
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        # A union writes files of one kind each, so their statistics skip those of the other.
        return self.spark.read.schema(ROWS).parquet(*folders).filter(F.col("kind") == kind)

    def read(self, upto: int | None = None) -> DataFrame:
        """(key, version, content, sha1) of every file's newest version, or of the newest up to a version.

        Which version that is is found on keys alone.
        """
        rows = self._rows(FILE, upto).select(*KEY, "version", "content", "sha1")
        newest = rows.groupBy(*KEY).agg(F.max("version").alias("version"))
        return rows.join(newest, [*KEY, "version"])

    def backups(self) -> DataFrame:
        """(key, version, backup_path, content): what a version replaced."""
        return self._rows(BACKUP).select(*KEY, "version", "backup_path", "content")

    # ---- committing

    def publish(self, writes: DataFrame, stamp: str, tries: int = 20) -> DataFrame:
        """Commit (key, new_content, base_sha1) and the backups of what they replace; (key, status, version) per file.

        `base_sha1` is the checksum of the content that the edit was made from; null
        means that there was no such file. A file whose checksum differs now gets
        `skipped_external_change` and is not written. Of rows that share a key one
        may be given only. If the write fails, nothing of it becomes visible.
        """
        given = kept(writes.select(*KEY, F.col("new_content").alias("_new"), F.col("base_sha1").alias("_base")))
        if not given.groupBy(*KEY).count().filter("count > 1").isEmpty():
            raise ValueError("two contents for one file in one batch")
        for _ in range(tries):
            last = max(self.versions(), default=0)
            now = self.read(last)
            held = now.select(*KEY, F.col("sha1").alias("_now"))
            same = F.col("_base").eqNullSafe(F.col("_now"))
            status = F.when(same, "ok").otherwise("skipped_external_change")
            checked = kept(given.join(held, KEY, "left").withColumn("status", status))
            reports = checked.select(*KEY, "status", F.when(F.col("status") == "ok", last + 1).cast("long").alias("version"))
            passed = checked.filter("status = 'ok'")
            if passed.isEmpty():
                return reports
            old = now.join(passed.filter("_now IS NOT NULL").select(*KEY), KEY, "left_semi")
            folder = f"data-{uuid.uuid4().hex}"
            if self._commit(passed, old, stamp, last + 1, folder):
                return reports
        raise RuntimeError(f"other batches were faster {tries} times")

    def _commit(self, passed: DataFrame, old: DataFrame, stamp: str, version: int, folder: str) -> bool:
        none = F.lit(None).cast("string")
        number = F.lit(version).cast("long").alias("version")
        new = passed.select(number, *KEY, none.alias("backup_path"), F.col("_new").alias("content"), sha1_content(F.col("_new")).alias("sha1"), F.lit(FILE).alias("kind"))
        saved = old.select(number, *KEY, backup_path(F.col("rel_path"), F.lit(stamp)).alias("backup_path"), "content", "sha1", F.lit(BACKUP).alias("kind"))
        done = False
        try:
            new.unionByName(saved).write.parquet(f"{self.path}/{folder}")
            done = self._record(version, folder)
        finally:
            if not done:
                self._log.fs.delete(self._log.hadoop(f"{self.path}/{folder}"), True)
        return done
