"""Catalogues, prompts and versioned snapshots in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.defaults import CATEGORIES, QUESTIONS, SNIPPETS
from folioflow.functions.text import sha1_content
from folioflow.operators.selection import KEY, latest_version
from folioflow.schemas import RESPONSES, SNIPPET_CATALOGUE

_SETTINGS = "struct<prompt_snippets: map<string, struct<items: map<string, string>>>>"


def default_snippets(spark: SparkSession) -> DataFrame:
    seen: dict[str, int] = {}
    rows = []
    for category, name, text in SNIPPETS:
        seen[category] = seen.get(category, -1) + 1
        rows.append((category, CATEGORIES.index(category), name, seen[category], text))
    return spark.createDataFrame(rows, SNIPPET_CATALOGUE)


def default_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "pos int, text string")


def parse_snippets(settings: DataFrame, json: str = "settings", owner: str = "owner_id") -> DataFrame:
    """Snippet rows of settings documents, in their order; an unreadable document gives none."""
    parsed = settings.select(owner, F.from_json(json, _SETTINGS).alias("_s"))
    categories = parsed.select(owner, F.posexplode(F.map_entries("_s.prompt_snippets")).alias("cat_pos", "_c"))
    return categories.select(
        owner, F.col("_c.key").alias("category"), "cat_pos", F.posexplode(F.map_entries("_c.value.items")).alias("item_pos", "_i")
    ).select(owner, "category", "cat_pos", F.col("_i.key").alias("name"), "item_pos", F.col("_i.value").alias("text"))


def read_snippets(spark: SparkSession, path: str | None) -> DataFrame:
    """The catalogue of a settings file; the defaults where it is missing or unreadable."""
    defaults = default_snippets(spark)
    if path is None:
        return defaults
    try:
        settings = spark.read.text(path, wholetext=True).select(F.lit(0).alias("owner_id"), F.col("value").alias("settings"))
        found = parse_snippets(settings).drop("owner_id")
        return defaults if found.isEmpty() else found
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return defaults
        raise


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RESPONSES).format(fmt).load(path)


def write_prompts(prompts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write prompt documents, one row per part; `part_no` orders the parts of a prompt."""
    prompts.write.mode("overwrite").format(fmt).save(path)


def write_segments(segments: DataFrame, path: str, prompt: str = "project_id") -> None:
    """Write context segments so that reading files in order gives each document."""
    segments.orderBy(prompt, "seq", "parts").write.mode("overwrite").parquet(path)


def snapshot(new_files: DataFrame, version: int | Column, *more: str) -> DataFrame:
    """File rows of one version, with checksum and the columns named; a final newline is ensured."""
    text = F.col("content")
    ended = F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    version = F.lit(version) if isinstance(version, int) else version
    return new_files.select(*KEY, *more, ended.alias("content")).withColumns(
        {"version": version.cast("long"), "sha1": sha1_content(F.col("content"))}
    )


def write_snapshot(new_files: DataFrame, path: str, version: int) -> None:
    """Publish a version: Spark commits the files at once, and a rerun replaces them."""
    (
        snapshot(new_files, version)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version")
        .parquet(path)
    )


def read_latest(spark: SparkSession, path: str, ts: str | None = None, before: int | None = None) -> DataFrame:
    """The newest row per file: by version, or by the time in `ts` and then by version, one row per file and version.

    With `before`, only lower versions count.
    """
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    if ts is None:
        return latest_version(rows)
    newest = rows.groupBy(*KEY).agg(F.max(F.struct(ts, "version")).alias("_newest"))
    return rows.join(newest.select(*KEY, "_newest.version"), [*KEY, "version"])
