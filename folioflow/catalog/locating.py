"""Queries of hunk location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.functions.text import split_lines
from folioflow.operators import locating as L

_ID = ["response_id", "hunk_pos"]


@query("hunks_with_file", f"""WITH {q.HUNKS}
SELECT response_id, rel_path, content, sha1(content) AS base_sha1, TRUE AS file_exists FROM hunks
UNION ALL SELECT response_id, rel_path || '.gone', NULL, NULL, FALSE FROM hunks""")
def hunks_with_file(spark: SparkSession, folder: str) -> DataFrame:
    """Each hunk against its file, and once more against a file that does not exist."""
    hunks = fx.hunks(spark, folder)
    both = hunks.union(hunks.withColumn("rel_path", F.concat("rel_path", F.lit(".gone"))))
    return L.hunks_with_file(both, fx.files(spark, folder)).select("response_id", "rel_path", "content", "base_sha1", "file_exists")


@query("hunks_with_file_salted", f"""WITH {q.MANY_HUNKS}
SELECT response_id, hunk_pos, rel_path, sha1(content) AS base_sha1 FROM hunks""")
def hunks_with_file_salted(spark: SparkSession, folder: str) -> DataFrame:
    """The join with every key of more than three hunks treated as hot."""
    target = fx.files(spark, folder).select("project_id", "rel_path", F.sha1("content").alias("base_sha1"))
    return L.skew_join(fx.many_hunks(spark, folder), target, ["project_id", "rel_path"], "left", _ID, rows_per_salt=3).select(
        *_ID, "rel_path", "base_sha1"
    )


@query("candidate_starts", f"""WITH {q.HUNKS}, {q.LOCATED}
SELECT response_id, CAST(unnest(starts) AS BIGINT) AS start FROM starts""")
def candidate_starts(spark: SparkSession, folder: str) -> DataFrame:
    found = L.candidate_starts(L.with_needle(L.hunks_with_file(fx.hunks(spark, folder), fx.files(spark, folder))))
    return found.select("response_id", F.explode(F.col("_starts").cast("array<long>")).alias("start"))


@query("best_match", f"""WITH {q.HUNKS}, {q.LOCATED}
SELECT response_id, CAST(start AS BIGINT) AS first_target_line, CAST(len(exact) AS BIGINT) AS n_best, CASE WHEN len(exact) > 0 THEN 1.0::DOUBLE END AS match_ratio FROM located""")
def best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The best start of each hunk; more than one best start means no match."""
    candidates = L.candidate_starts(L.with_needle(L.hunks_with_file(fx.hunks(spark, folder), fx.files(spark, folder))))
    return L.best_match(candidates).select("response_id", "first_target_line", "n_best", "match_ratio")


@query("locate_hunks", f"""WITH {q.MANY_HUNKS}, {q.LOCATED}
SELECT response_id, hunk_pos, status, CAST(start AS BIGINT) AS first_target_line FROM located""")
def locate_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """Many hunks per file."""
    return L.locate_hunks(fx.many_hunks(spark, folder), fx.files(spark, folder)).select(*_ID, "status", "first_target_line")


@query("locate_hunks_one_file", f"""WITH {q.HOT_HUNKS}, {q.LOCATED}
SELECT response_id, hunk_pos, status, CAST(start AS BIGINT) AS first_target_line, CAST(len(exact) AS BIGINT) AS n_best FROM located""")
def locate_hunks_one_file(spark: SparkSession, folder: str) -> DataFrame:
    """Ten times as many hunks on one file as there are documents."""
    return L.locate_hunks(fx.hot_hunks(spark, folder), fx.files(spark, folder)).select(*_ID, "status", "first_target_line", "n_best")


@query("locate_long_hunks", f"""WITH {q.FILES},
numbered AS (SELECT doc_id, CAST(len(L) AS BIGINT) AS n FROM (SELECT doc_id, string_split(content, chr(10)) AS L FROM files))
SELECT doc_id AS response_id, CASE WHEN 2 * n * 0.05 >= 2 THEN 'matched' ELSE 'unmatched' END AS status,
  CASE WHEN 2 * n * 0.05 >= 2 THEN CAST(0 AS BIGINT) END AS first_target_line,
  CASE WHEN 2 * n * 0.05 >= 2 THEN round((2 * n - 2) / (2.0 * n), 9)::DOUBLE END AS match_ratio FROM numbered""")
def locate_long_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """A hunk as long as its file, which holds every line of a document twice, with two lines changed.

    The tolerance admits it from 40 lines on. Line numbers make all lines distinct.
    """
    lines = F.transform(split_lines(F.col("content")), lambda line, i: F.concat(line, F.lit(" #"), i.cast("string")))
    doubled = F.concat(lines, F.transform(lines, lambda line: F.concat(line, F.lit(" again"))))
    files = fx.files(spark, folder).withColumn("_d", doubled).withColumn("content", F.array_join("_d", "\n"))
    changed = F.transform(F.col("_d"), lambda line, i: F.when(i.isin(0) | (i == F.size("_d") - 1), F.concat(line, F.lit(" changed"))).otherwise(line))
    hunks = files.select(
        F.col("doc_id").alias("response_id"), F.lit(0).alias("hunk_pos"), "project_id", "rel_path",
        F.array(F.lit("+new")).alias("hunk_lines"), changed.alias("context_before"), F.array().cast("array<string>").alias("context_after"),
    )
    return L.locate_hunks(hunks, files).select("response_id", "status", "first_target_line", F.round("match_ratio", 9).alias("match_ratio"))
