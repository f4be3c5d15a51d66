"""Located hunks and proposed contents to new file versions and reports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.hunks import change_lines, line_changes, original_lines
from folioflow.functions.paths import backup_path
from folioflow.functions.text import once, sha1_content, split_lines
from folioflow.operators.locating import HUNK_ID
from folioflow.operators.selection import KEY
from folioflow.operators.skew import only_named, running_rank, running_total, skew_join
from folioflow.session import kept

# Lines of a file that are edited together.
CHUNK_LINES = 1024


# The texts of a hunk, and the figures that reports and checks of overlaps need of them.
TEXTS = ["hunk_lines", "context_before", "context_after"]
MEASURES = ["_added", "_deleted", "_block_length"]


def measured(hunks: DataFrame) -> DataFrame:
    """Hunks with their `MEASURES`: added and deleted lines, and lines that the file must hold. Measured rows stay as they are.

    Hunks that are measured before they are located can be reported on without their `TEXTS`.
    """
    if set(MEASURES) <= set(hunks.columns):
        return hunks
    counts = line_changes(F.col("hunk_lines"))
    length = F.size(original_lines(F.col("context_before"), F.col("hunk_lines"), F.col("context_after")))
    return hunks.withColumns({"_added": counts["added"], "_deleted": counts["deleted"], "_block_length": length.cast("long")})


def hunk_order(located: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Matched hunks of each file numbered by start line."""
    matched = located.filter(F.col("status") == "matched").select(*KEY, *HUNK_ID, "first_target_line")
    return running_rank(matched, KEY, ["first_target_line", *HUNK_ID], "pos", max_group_rows)


def hunk_offsets(located: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """How far the earlier hunks of a file shift each hunk: added minus deleted lines."""
    matched = measured(located).filter(F.col("status") == "matched").select(
        *KEY, *HUNK_ID, "first_target_line", (F.col("_added") - F.col("_deleted")).alias("delta"),
        F.col("_block_length").alias("block_length"),
    )
    order = ["first_target_line", *HUNK_ID]
    running = running_total(matched, KEY, order, {"_upto": "delta"}, max_group_rows)
    return running.withColumn("shift", F.col("_upto") - F.col("delta")).drop("_upto")


def overlap_check(located: DataFrame, mode: str = "original", max_group_rows: int | None = None) -> DataFrame:
    """Files whose hunks overlap.

    Hunks are put in order of their starts, one row each; if any two overlap, then
    so do two neighbours. In `original` coordinates a hunk claims the lines it was
    found at, if any; `shifted` compares where hunks begin and end after the shifts
    of those before.
    """
    order = ["first_target_line", *HUNK_ID]
    if mode == "original":
        length = F.col("_block_length")
        matched = measured(located).filter((F.col("status") == "matched") & (length > 0))
        spans = matched.select(*KEY, *order, F.col("first_target_line").alias("_start"), (F.col("first_target_line") + length).alias("_end"))
    elif mode == "shifted":
        moved = hunk_offsets(located, max_group_rows)
        start = F.col("first_target_line") + F.col("shift")
        spans = moved.select(*KEY, *order, start.alias("_start"), (start + F.col("block_length")).alias("_end"))
    else:
        raise ValueError(f"unknown overlap mode {mode!r}")
    ranked = running_rank(spans, KEY, order, "pos", max_group_rows)
    ends = ranked.select(*KEY, (F.col("pos") + 1).alias("pos"), F.col("_end").alias("_before"))
    return ranked.select(*KEY, "pos", "_start").join(ends, [*KEY, "pos"]).filter("_start < _before").select(*KEY).distinct()


def external_change_check(located: DataFrame, files_now: DataFrame) -> DataFrame:
    """Per file with hunks: the checksum at locate time, the one now, and whether they differ."""
    base = located.groupBy(*KEY).agg(F.max("base_sha1").alias("base_sha1"))
    now = only_named(files_now, base, KEY).select(*KEY, sha1_content(F.col("content")).alias("sha1_now"))
    changed = ~F.col("base_sha1").eqNullSafe(F.col("sha1_now"))
    return base.join(now, KEY, "left").withColumn("changed", changed)


def apply_reports(located: DataFrame, files_now: DataFrame, overlap_mode: str = "original") -> DataFrame:
    """One outcome per file, decided before anything is written."""
    located = measured(located)
    per_file = located.groupBy(*KEY).agg(
        F.bool_or(F.col("file_exists")).alias("file_exists"),
        F.bool_or(~F.col("file_exists") & (F.col("_deleted") > 0)).alias("_deletes_missing"),
        F.count_if(F.col("status") == "unmatched").alias("n_unmatched"),
        F.count_if(F.col("status") == "matched").alias("_n_matched"),
        F.sum(F.col("_added") + F.col("_deleted")).alias("_changed_lines"),
    )
    overlaps = overlap_check(located, overlap_mode).withColumn("_overlap", F.lit(True))
    checked = external_change_check(located, files_now).select(*KEY, "sha1_now", "changed")
    gates = per_file.join(overlaps, KEY, "left").join(checked, KEY, "left")
    status = (
        F.when(F.col("_deletes_missing"), "failed_read")
        .when(F.col("n_unmatched") > 0, "skipped_unmatched")
        .when(F.col("_n_matched") == 0, "no_action")
        .when(F.col("_overlap"), "skipped_overlap")
        .when(F.col("file_exists") & F.col("sha1_now").isNull(), "failed_read")
        .when(F.col("changed"), "skipped_external_change")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    message = (
        F.when(F.col("_deletes_missing"), "file does not exist, but a hunk deletes lines")
        .when(F.col("status") == "failed_read", "file is no longer there")
        .when(F.col("status") == "skipped_unmatched", F.concat(F.col("n_unmatched").cast("string"), F.lit(" hunk(s) could not be located")))
        .when(F.col("status") == "no_action", "no matched hunks")
        .when(F.col("status") == "skipped_overlap", "hunks overlap")
        .when(F.col("status") == "skipped_external_change", "file changed since it was located")
        .otherwise("changes applied")
    )
    return gates.withColumn("status", status).select(
        *KEY, "status", "n_unmatched", message.alias("message"),
        F.when(ok, F.col("_changed_lines")).alias("lines_applied"), "file_exists",
    )


def unmatched_hunks(located: DataFrame) -> DataFrame:
    """The hunks behind `skipped_unmatched`, one row each."""
    return located.filter(F.col("status") == "unmatched").select(*KEY, *HUNK_ID)


def piece_table(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What hunks do to their files, as rows by line of the file: (inserts, deletes).

    `inserts` holds (key, pos, text): the lines that go before line `pos`, in the
    order of hunks and of lines in them. `deletes` holds (key, pos). Kept lines need
    no row: they stay as the file has them.
    """
    body_start = F.col("first_target_line") + F.size("context_before")
    lines = edits.select(*KEY, *HUNK_ID, "first_target_line", body_start.alias("_from"), F.posexplode("hunk_lines").alias("_i", "_line"))
    # Only added lines take their text along.
    mark, added = F.substring("_line", 1, 1), F.col("_mark") == "+"
    lines = lines.withColumn("_mark", mark).withColumn("_line", F.when(added, F.col("_line")))
    # Lines of the file that the hunk has gone over before this one.
    before = Window.partitionBy(*KEY, "first_target_line", *HUNK_ID).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("pos", F.col("_from") + F.coalesce(F.sum((~added).cast("long")).over(before), F.lit(0)))
    one = F.struct("first_target_line", *HUNK_ID, "_i", F.substring("_line", F.lit(2), F.length("_line")).alias("text"))
    inserts = lines.filter(added).groupBy(*KEY, "pos").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    inserts = inserts.select(*KEY, "pos", F.array_join(F.transform("_all", lambda x: x["text"]), "\n").alias("text"))
    return inserts, lines.filter(F.col("_mark") == "-").select(*KEY, "pos")


def spliced(target: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """(key, new_content) of the files (key, content) and of new ones, with the pieces put in.

    Files are cut into chunks of lines, and only a chunk's own pieces meet it, so
    time is linear in the lines of files and hunks however many hunks a file has.
    """
    chunk = F.floor(F.col("pos") / CHUNK_LINES).cast("long").alias("_chunk")
    cut = deletes.select(*KEY, chunk, (F.col("pos") % CHUNK_LINES).cast("int").alias("_p"))
    entry = F.struct((F.col("pos") % CHUNK_LINES).cast("int").alias("p"), F.lit(0).alias("k"), F.col("text").alias("text"))
    both_kinds = cut.unionByName(inserts.select(*KEY, chunk, entry.alias("_e")), allowMissingColumns=True)
    # One table of pieces, so that the lines of files are shuffled to one join only.
    edits = both_kinds.groupBy(*KEY, "_chunk").agg(F.collect_set("_p").alias("_cut"), F.collect_list("_e").alias("_new"))
    edits = edits.withColumns({name: F.when(F.size(name) > 0, F.col(name)) for name in ("_cut", "_new")})
    lines = target.select(*KEY, once(split_lines(F.col("content"))).alias("_lines"))
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_lines") / CHUNK_LINES).cast("int") - 1, F.lit(0)))
    parts = F.transform(chunks, lambda c: F.struct(c.cast("long").alias("_chunk"), F.slice("_lines", c * CHUNK_LINES + 1, F.lit(CHUNK_LINES)).alias("_old")))
    pieces = lines.select(*KEY, F.inline(parts)).join(edits, [*KEY, "_chunk"], "full")

    def old(i: Column) -> Column:
        return F.struct(i.alias("p"), F.lit(1).alias("k"), F.get("_old", i).alias("text"))

    none = F.array().cast("array<int>")
    count = F.coalesce(F.size("_old"), F.lit(0))
    places = F.when(count > 0, F.array_except(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.coalesce("_cut", none))).otherwise(none)
    kept_lines = F.transform(places, old)
    both = F.array_sort(F.concat(kept_lines, F.coalesce(F.col("_new"), F.slice(kept_lines, 1, 0))))
    text = F.when(F.col("_cut").isNull() & F.col("_new").isNull(), F.col("_old")).otherwise(F.transform(both, lambda x: x["text"]))
    rows = pieces.select(*KEY, "_chunk", once(text).alias("_text"))
    joined = F.when(F.size("_text") > 0, F.struct("_chunk", F.array_join("_text", "\n").alias("text")))
    whole = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(joined)).alias("_parts"))
    content = F.concat(F.array_join(F.transform("_parts", lambda part: part["text"]), "\n"), F.lit("\n"))
    return whole.select(*KEY, F.when(F.size("_parts") > 0, content).otherwise("").alias("new_content"))


def apply_hunk_lines(located: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """New content of every file whose report is ok, by a table of pieces.

    The only row that grows with the hunks of a file is its new content.
    """
    ok = reports.filter(F.col("status") == "ok").select(*KEY)
    edits = skew_join(located, ok, KEY, "left_semi", HUNK_ID)
    inserts, deletes = piece_table(edits)
    target = kept(only_named(files.select(*KEY, "content"), ok, KEY).join(ok, KEY, "left_semi"))
    rebuilt = spliced(target, inserts, deletes)
    return rebuilt.join(target.withColumnRenamed("content", "old_content"), KEY, "left").select(*KEY, "new_content", "old_content")


def lines_applied(located: DataFrame) -> DataFrame:
    """Changed lines per file over its matched hunks."""
    return measured(located).filter(F.col("status") == "matched").groupBy(*KEY).agg(
        F.sum(F.col("_added") + F.col("_deleted")).alias("lines_applied")
    )


def backups(applied: DataFrame, stamp: str | None) -> DataFrame:
    """Pre-images of changed files that existed, under their backup path.

    Without a stamp there is one backup per path, which a later one replaces.
    """
    path = F.col("rel_path")
    target = F.concat(F.lit("backups/"), path) if stamp is None else backup_path(path, F.lit(stamp))
    existed = applied.filter(F.col("old_content").isNotNull())
    if stamp is None and "response_id" in applied.columns:
        latest = existed.groupBy(*KEY).agg(F.max("response_id").alias("response_id"))
        existed = existed.join(latest, [*KEY, "response_id"])
    if stamp is None:
        existed = existed.dropDuplicates(KEY)
    return existed.select(*KEY, target.alias("backup_path"), F.col("old_content").alias("content"))


def prune_backups(backup_rows: DataFrame, now_s: int, days: int) -> DataFrame:
    """Adds `pruned`: true where a backup is older than `days`; nothing is when days is not positive."""
    if days <= 0:
        return backup_rows.withColumn("pruned", F.lit(False))
    return backup_rows.withColumn("pruned", F.col("mtime_s") < now_s - days * 86400)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    def diff(old: str | None, new: str | None) -> list[str] | None:
        if old is None or new is None:
            return None
        return list(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm=""))

    return pd.Series([diff(b, a) for b, a in zip(before, after)])


def apply_proposed(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-file replacement: the new content and outcome of each suggestion.

    A diff without proposed content is not applied.
    """
    target = only_named(files, suggestions, KEY).select(*KEY, F.col("content").alias("old_content"))
    joined = skew_join(suggestions, target, KEY, "left", ["response_id"])
    given, exists = F.col("proposed_content").isNotNull(), F.col("old_content").isNotNull()
    has_diff = F.coalesce("diff_text", F.lit("")) != ""
    return joined.withColumns({
        "status": F.when(given, "applied_ok").otherwise("failed"),
        "message": F.when(given & ~exists, "new file")
        .when(given & ~has_diff, "not verified: no diff text")
        .when(given, "replaced")
        .when(has_diff & ~exists, "file not found for diff")
        .when(has_diff, "diff text alone is not applied")
        .otherwise("no content"),
        "new_content": F.col("proposed_content"),
    })


def verify_applied(applied: DataFrame) -> DataFrame:
    """Compare what changed with the claimed diff; a mismatch is reported, not undone."""
    check = (
        (F.col("status") == "applied_ok") & F.col("old_content").isNotNull()
        & (F.coalesce("diff_text", F.lit("")) != "")
    )
    actual = _unified_diff(F.when(check, F.col("old_content")), F.when(check, F.col("new_content")))
    rows = applied.withColumn("_actual", actual)
    differs = check & (change_lines(F.col("_actual")) != change_lines(split_lines(F.col("diff_text"))))
    return rows.withColumns({
        "status": F.when(differs, "applied_with_discrepancies").otherwise(F.col("status")),
        "message": F.when(differs, "verification failed").when(check, "verified").otherwise(F.col("message")),
    }).drop("_actual")


SUMMARY_HEADINGS = [
    ("skipped_unmatched", "Left alone, as a hunk has no place:"),
    ("skipped_external_change", "Left alone, as others changed the file:"),
    ("skipped_overlap", "Left alone, as hunks overlap:"),
    ("applied_with_discrepancies", "Written, but not as the diff says:"),
    ("failed", "Not written:"),
]


def _outcome() -> Column:
    """The status of a report; whatever failed is one outcome."""
    return F.when(F.col("status").startswith("failed"), "failed").otherwise(F.col("status"))


def _listed() -> Column:
    """A file as a summary lists it: one that failed with its message."""
    return F.when(_outcome() == "failed", F.concat("rel_path", F.lit(" ("), "message", F.lit(")"))).otherwise(F.col("rel_path"))


def apply_summary(reports: DataFrame) -> DataFrame:
    """Per project: applicable and applied files, lines, and the files of each outcome, counted and listed in order.

    The lists hold paths only; `summary_lines` has them as rows.
    """
    outcomes = list(zip(["unmatched", "external", "overlap", "discrepancies", "failed"], SUMMARY_HEADINGS))
    return reports.groupBy("project_id").agg(
        F.count("*").alias("n_applicable"),
        F.count_if(F.col("status").isin("ok", "applied_ok", "applied_with_discrepancies")).alias("n_applied"),
        F.coalesce(F.sum("lines_applied"), F.lit(0)).cast("long").alias("lines_affected"),
        *[F.count_if(_outcome() == status).alias(f"n_{name}") for name, (status, _) in outcomes],
        *[F.sort_array(F.collect_list(F.when(_outcome() == status, _listed()))).alias(f"{name}_files") for name, (status, _) in outcomes],
    )


def summary_lines(reports: DataFrame) -> DataFrame:
    """The file lists of a summary as rows: (project_id, section, heading, text)."""
    section = heading = None
    for pos, (status, title) in enumerate(SUMMARY_HEADINGS, 1):
        hit = _outcome() == status
        section = F.when(hit, pos) if section is None else section.when(hit, pos)
        heading = F.when(hit, title) if heading is None else heading.when(hit, title)
    return reports.select(
        "project_id", section.cast("long").alias("section"), heading.alias("heading"), F.concat(F.lit("- "), _listed()).alias("text")
    ).filter(F.col("section").isNotNull())


def drop_applied(changes: DataFrame, reports: DataFrame) -> DataFrame:
    """Changes that remain after a batch: all but the accepted ones of written files."""
    written = reports.filter(F.col("status").isin("ok", "applied_ok", "applied_with_discrepancies"))
    accepted = F.col("status") == "accepted"
    marked = skew_join(
        changes, written.select(*KEY).distinct().withColumn("_written", F.lit(True)), KEY, "left", HUNK_ID
    )
    return marked.filter(~(F.coalesce("_written", F.lit(False)) & accepted)).drop("_written")
