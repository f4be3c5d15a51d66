"""Queries of edits, versions and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.functions.paths import backup_path
from folioflow.functions.text import sha1_content
from folioflow.operators import applying as A
from folioflow.operators.extraction import extract_changes
from folioflow.operators.locating import locate_hunks
from folioflow.plans import edit_files, publish_edits
from folioflow.session import ensure_checkpoint_dir, kept
from folioflow.sources.filestore import FileStore
from folioflow.sources.tables import snapshot

_KEY = ["project_id", "rel_path"]
_ID = ["response_id", "hunk_pos"]


def _located(spark: SparkSession, folder: str, hunks: DataFrame | None = None) -> DataFrame:
    """Located hunks with their measures in place of their texts."""
    hunks = A.measured(fx.many_hunks(spark, folder) if hunks is None else hunks)
    return kept(locate_hunks(hunks, fx.files(spark, folder)).drop(*A.TEXTS))


_MATCHED = f"""WITH {q.MANY_HUNKS}, {q.LOCATED},
matched AS (SELECT *, CAST(start AS BIGINT) AS first_target_line FROM located WHERE status = 'matched')"""


@query("hunk_order", f"""{_MATCHED}
SELECT response_id, hunk_pos, row_number() OVER (PARTITION BY project_id, rel_path ORDER BY first_target_line, hunk_pos) AS pos FROM matched""")
def hunk_order(spark: SparkSession, folder: str) -> DataFrame:
    return A.hunk_order(_located(spark, folder)).select(*_ID, "pos")


_SHIFTS = f"""{_MATCHED}
SELECT response_id, hunk_pos, first_target_line, CAST(coalesce(sum(1) OVER (PARTITION BY project_id, rel_path ORDER BY first_target_line, hunk_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM matched"""


@query("hunk_offsets", _SHIFTS)
def hunk_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Each hunk adds two lines and deletes one."""
    return A.hunk_offsets(_located(spark, folder)).select(*_ID, "first_target_line", "shift")


@query("hunk_offsets_blocks", _SHIFTS)
def hunk_offsets_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same, by the way that files with very many hunks take."""
    return A.hunk_offsets(_located(spark, folder), max_group_rows=0).select(*_ID, "first_target_line", "shift")


_OVERLAPS = """clashes AS (SELECT DISTINCT project_id, rel_path FROM (
  SELECT *, lead(first_target_line) OVER (PARTITION BY project_id, rel_path ORDER BY first_target_line, hunk_pos) AS next FROM matched) WHERE next < first_target_line + m)"""


@query("overlap_check", f"{_MATCHED}, {_OVERLAPS} SELECT project_id, rel_path FROM clashes")
def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    return A.overlap_check(_located(spark, folder))


@query("overlap_check_shifted", f"""{_MATCHED},
shifted AS (SELECT *, first_target_line - coalesce(sum(1) OVER (PARTITION BY project_id, rel_path ORDER BY first_target_line, hunk_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM matched)
SELECT DISTINCT project_id, rel_path FROM (SELECT *, lead(spot) OVER (PARTITION BY project_id, rel_path ORDER BY first_target_line, hunk_pos) AS next FROM shifted)
WHERE next < spot + m""")
def overlap_check_shifted(spark: SparkSession, folder: str) -> DataFrame:
    """Shifted starts against unshifted lengths, as an option. Here every hunk only deletes its line."""
    hunks = fx.many_hunks(spark, folder).withColumn("_whole", F.col("hunk_lines"))
    deletions = A.measured(hunks.withColumn("hunk_lines", F.slice("hunk_lines", 1, 1)))
    located = _located(spark, folder, deletions.withColumn("hunk_lines", F.col("_whole")).drop("_whole"))
    return A.overlap_check(located, "shifted")


# Since the hunks were located, the files of one language have changed.
_NOW = "now AS (SELECT project_id, rel_path, CASE WHEN lang = 'fr' THEN content || '!' ELSE content END AS content FROM files)"


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return fx.files(spark, folder).withColumn(
        "content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )


@query("external_change_check", f"""WITH {q.FILES}, {_NOW}
SELECT project_id, rel_path, sha1(f.content) AS base_sha1, sha1(n.content) AS sha1_now, f.content <> n.content AS changed FROM files f JOIN now n USING (project_id, rel_path)""")
def external_change_check(spark: SparkSession, folder: str) -> DataFrame:
    return A.external_change_check(_located(spark, folder), _now(spark, folder))


_REPORTS = f"""{_MATCHED}, {_OVERLAPS}, {_NOW},
outcomes AS (SELECT l.project_id, l.rel_path, count(*) FILTER (l.status = 'unmatched') AS n_unmatched, CAST(count(*) * 3 AS BIGINT) AS changed_lines,
  any_value(o.rel_path) IS NOT NULL AS clash, any_value(l.content) <> any_value(n.content) AS changed
  FROM located l JOIN now n USING (project_id, rel_path) LEFT JOIN clashes o USING (project_id, rel_path) GROUP BY l.project_id, l.rel_path),
reports AS (SELECT *, CASE WHEN n_unmatched > 0 THEN 'skipped_unmatched' WHEN clash THEN 'skipped_overlap' WHEN changed THEN 'skipped_external_change' ELSE 'ok' END AS status FROM outcomes)"""


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return A.apply_reports(_located(spark, folder), _now(spark, folder))


@query("apply_reports", f"""{_REPORTS}
SELECT project_id, rel_path, status, n_unmatched, CASE WHEN status = 'ok' THEN changed_lines END AS lines_applied FROM reports""")
def apply_reports(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select(*_KEY, "status", "n_unmatched", "lines_applied")


@query("unmatched_hunks", f"WITH {q.MANY_HUNKS}, {q.LOCATED} SELECT project_id, rel_path, response_id, hunk_pos FROM located WHERE status = 'unmatched'")
def unmatched_hunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.unmatched_hunks(_located(spark, folder))


# A replaced line becomes its edited form and one line more.
_EDITED = """edited AS (SELECT r.project_id, r.rel_path, f.content AS old_content, array_to_string(list_transform(string_split(f.content, chr(10)), lambda l, i:
    CASE WHEN list_contains(r.hit, i - 1) THEN l || ' [edited]' || chr(10) || '+more'[2:] ELSE l END), chr(10)) || chr(10) AS new_content
  FROM (SELECT r.project_id, r.rel_path, list(m.first_target_line + len(m.cb)) AS hit FROM reports r JOIN matched m USING (project_id, rel_path)
    WHERE r.status = 'ok' GROUP BY r.project_id, r.rel_path) r JOIN files f USING (project_id, rel_path))"""


def _edited(spark: SparkSession, folder: str) -> DataFrame:
    located = kept(locate_hunks(fx.many_hunks(spark, folder), fx.files(spark, folder)))
    reports = kept(A.apply_reports(located, _now(spark, folder)))
    return A.apply_hunk_lines(located, reports, fx.files(spark, folder))


@query("apply_hunk_lines", f"{_REPORTS}, {_EDITED} SELECT project_id, rel_path, new_content, old_content FROM edited")
def apply_hunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _edited(spark, folder)


@query("lines_applied", f"{_MATCHED} SELECT project_id, rel_path, CAST(count(*) * 3 AS BIGINT) AS lines_applied FROM matched GROUP BY project_id, rel_path")
def lines_applied(spark: SparkSession, folder: str) -> DataFrame:
    return A.lines_applied(_located(spark, folder))


@query("edit_files", f"""WITH {q.HUNKS}, {q.LOCATED}
SELECT project_id, rel_path, array_to_string(list_concat(L[1:start + len(cb)], [L[k + 1] || ' [edited]'], L[start + len(cb) + 2:]), chr(10)) || chr(10) AS new_content
FROM located WHERE status = 'matched' AND response_id % 6 IN (0, 1)""")
def edit_files_query(spark: SparkSession, folder: str) -> DataFrame:
    """The whole second job: from responses to new file contents."""
    return edit_files(fx.responses(spark, folder), fx.files(spark, folder)).new_files.select(*_KEY, "new_content")


_STORED = f"""WITH {q.HUNKS}, {q.LOCATED},
planned AS (SELECT project_id, rel_path, content, response_id % 5 = 0 AS outside, response_id % 6 IN (0, 1) AND status = 'unmatched' AS unmatched,
  CASE WHEN response_id % 6 IN (0, 1) AND status = 'matched' THEN
      array_to_string(list_concat(L[1:start + len(cb)], [L[k + 1] || ' [edited]'], L[start + len(cb) + 2:]), chr(10)) || chr(10)
    WHEN response_id % 6 IN (2, 3) THEN {q.strip("content || chr(10) || 'last line'")} || chr(10) END AS new
  FROM located)"""


@query("publish_edits", f"""{_STORED}
SELECT project_id, rel_path, CASE WHEN outside THEN CAST(2 AS BIGINT) WHEN new IS NOT NULL THEN 3 ELSE 1 END AS version,
  sha1(CASE WHEN outside THEN content || chr(10) || 'from outside' ELSE coalesce(new, content) END) AS sha1,
  CASE WHEN outside OR new IS NOT NULL THEN sha1(content) END AS backup_sha1,
  CASE WHEN new IS NOT NULL AND outside THEN 'skipped_external_change' WHEN new IS NOT NULL THEN 'ok' WHEN unmatched THEN 'skipped_unmatched' END AS status
FROM planned""")
def publish_edits_query(spark: SparkSession, folder: str) -> DataFrame:
    """Files are stored, edited, and every fifth changed by others before the edits are published; the sinks are read back."""
    store = FileStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    files = fx.files(spark, folder)
    store.publish(files.select(*_KEY, F.col("content").alias("new_content"), F.lit(None).cast("string").alias("base_sha1")), "20240101_000000")
    result = edit_files(fx.responses(spark, folder), store.read())
    others = files.filter("doc_id % 5 = 0").select(
        *_KEY, F.concat("content", F.lit("\nfrom outside")).alias("new_content"), sha1_content(F.col("content")).alias("base_sha1")
    )
    store.publish(others, "20240101_000001")
    reports = publish_edits(result, store, "20240101_000002")
    saved = store.backups().select(*_KEY, sha1_content(F.col("content")).alias("backup_sha1"))
    return store.read().select(*_KEY, "version", "sha1").join(saved, _KEY, "left").join(reports.select(*_KEY, "status"), _KEY, "left")


_SUGGESTED = f"""WITH {q.HUNKS},
suggestions AS (SELECT response_id, project_id, CASE WHEN response_id % 7 = 3 THEN rel_path || '.new' ELSE rel_path END AS rel_path, hunk_lines, content, response_id % 7 AS kind FROM hunks)"""


@query("apply_proposed", f"""{_SUGGESTED}
SELECT response_id, rel_path, CASE WHEN kind = 4 THEN 'failed' ELSE 'applied_ok' END AS status,
  CASE kind WHEN 3 THEN 'new file' WHEN 4 THEN 'diff text alone is not applied' WHEN 5 THEN 'not verified: no diff text' ELSE 'replaced' END AS message,
  CASE WHEN kind <> 4 THEN content || chr(10) || 'last line' END AS new_content, CASE WHEN kind <> 3 THEN content END AS old_content
FROM suggestions""")
def apply_proposed(spark: SparkSession, folder: str) -> DataFrame:
    return A.apply_proposed(fx.suggestions(spark, folder), fx.files(spark, folder)).select(
        "response_id", "rel_path", "status", "message", "new_content", "old_content"
    )


@query("verify_applied", f"""{_SUGGESTED}
SELECT response_id, CASE WHEN kind = 4 THEN 'failed' WHEN kind IN (3, 5) THEN 'applied_ok' WHEN lang = 'en' THEN 'applied_ok' ELSE 'applied_with_discrepancies' END AS status
FROM suggestions JOIN (SELECT doc_id AS response_id, lang FROM documents) USING (response_id)""")
def verify_applied(spark: SparkSession, folder: str) -> DataFrame:
    """One line is added to every file; the claimed diff says so for one language only."""
    lang = fx.table(spark, folder, "documents").select(F.col("doc_id").alias("response_id"), "lang")
    claim = F.when((F.col("lang") == "en") & (F.col("diff_text") != ""), "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+last line ").otherwise(F.col("diff_text"))
    suggestions = fx.suggestions(spark, folder).join(lang, "response_id").withColumn("diff_text", claim)
    return A.verify_applied(A.apply_proposed(suggestions, fx.files(spark, folder))).select("response_id", "status")


_BACKUP = "'backups/' || regexp_replace(rel_path, '[^/]*$', '') || regexp_replace(string_split(rel_path, '/')[-1], '\\.[^.]+$', '') || '_20240101_000000' || regexp_extract(rel_path, '\\.[^./]+$')"


@query("backup", f"{_REPORTS}, {_EDITED} SELECT project_id, rel_path, {_BACKUP} AS backup_path, old_content AS content FROM edited")
def backup(spark: SparkSession, folder: str) -> DataFrame:
    return A.backups(_edited(spark, folder), "20240101_000000")


@query("backup_replaced_files", f"{_SUGGESTED} SELECT project_id, rel_path, 'backups/' || rel_path AS backup_path, content FROM suggestions WHERE kind NOT IN (3, 4)")
def backup_replaced_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-file replacements leave one backup per path."""
    replaced = A.apply_proposed(fx.suggestions(spark, folder), fx.files(spark, folder)).filter("status <> 'failed'")
    return A.backups(replaced, None)


@query("write_snapshot", f"""WITH {q.FILES}
SELECT project_id, rel_path, CAST(3 AS BIGINT) AS version, c AS content, sha1(c) AS sha1 FROM (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN content ELSE content || chr(10) END AS c FROM (
    SELECT project_id, rel_path, doc_id, CASE WHEN doc_id % 3 = 0 THEN content || chr(10) ELSE content END AS content FROM files))""")
def write_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the snapshot sink writes; a final newline is ensured, not doubled."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    return snapshot(fx.files(spark, folder).withColumn("content", content), 3)


@query("prune_backups", f"""WITH {q.FILES}
SELECT project_id, {_BACKUP} AS backup_path, mtime_s < 1704067200 + 86400 * 10 - 7 * 86400 AS pruned FROM files""")
def prune_backups(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.files(spark, folder).select(
        "project_id", "mtime_s", backup_path(F.col("rel_path"), F.lit("20240101_000000")).alias("backup_path")
    )
    return A.prune_backups(rows, now_s=1704067200 + 86400 * 10, days=7).select("project_id", "backup_path", "pruned")


def _files_of(status: str, text: str = "rel_path") -> str:
    return f"coalesce(array_to_string(list_sort(list({text}) FILTER ({status})), chr(10)), '')"


@query("apply_summary", f"""{_REPORTS}
SELECT project_id, count(*) AS n_applicable, count(*) FILTER (status = 'ok') AS n_applied, CAST(coalesce(sum(changed_lines) FILTER (status = 'ok'), 0) AS BIGINT) AS lines_affected,
  count(*) FILTER (status = 'skipped_unmatched') AS n_unmatched, count(*) FILTER (status = 'skipped_external_change') AS n_external,
  count(*) FILTER (status = 'skipped_overlap') AS n_overlap, count(*) FILTER (status = 'applied_with_discrepancies') AS n_discrepancies,
  count(*) FILTER (starts_with(status, 'failed')) AS n_failed,
  {_files_of("status = 'skipped_unmatched'")} AS unmatched_files, {_files_of("status = 'skipped_external_change'")} AS external_files,
  {_files_of("status = 'skipped_overlap'")} AS overlap_files, {_files_of("status = 'applied_with_discrepancies'")} AS discrepancies_files,
  {_files_of("starts_with(status, 'failed')")} AS failed_files
FROM reports GROUP BY project_id""")
def apply_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, and the files of each outcome, a line each. Reports of hunks have no discrepancies: only whole replacements are verified."""
    summary = A.apply_summary(_reports(spark, folder))
    lists = [c for c in summary.columns if c.endswith("_files")]
    return summary.withColumns({c: F.array_join(c, "\n") for c in lists})


@query("summary_lines", f"""{_REPORTS}
SELECT project_id, CASE status WHEN 'skipped_unmatched' THEN CAST(1 AS BIGINT) WHEN 'skipped_external_change' THEN 2 ELSE 3 END AS section,
  CASE status WHEN 'skipped_unmatched' THEN 'Left alone, as a hunk has no place:' WHEN 'skipped_external_change' THEN 'Left alone, as others changed the file:' ELSE 'Left alone, as hunks overlap:' END AS heading,
  '- ' || rel_path AS text FROM reports WHERE status <> 'ok'""")
def summary_lines(spark: SparkSession, folder: str) -> DataFrame:
    return A.summary_lines(_reports(spark, folder))


@query("drop_applied", f"""{_REPORTS}
SELECT response_id, hunk_pos, l.project_id, l.rel_path FROM located l JOIN reports r USING (project_id, rel_path)
WHERE NOT (r.status = 'ok' AND hunk_pos % 2 = 0)""")
def drop_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Every second hunk of each file was accepted."""
    located = _located(spark, folder)
    reports = A.apply_reports(located, _now(spark, folder))
    accepted = located.withColumn("status", F.when(F.col("hunk_pos") % 2 == 0, "accepted").otherwise("pending"))
    return A.drop_applied(accepted, reports).select(*_ID, *_KEY)


@query("extracted_paths", f"""WITH {q.HUNKS}
SELECT DISTINCT project_id, rel_path FROM hunks WHERE response_id % 6 IN (0, 1, 2, 3)""")
def extracted_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that either kind of change touches."""
    found = extract_changes(fx.responses(spark, folder))
    return found.hunks.select(*_KEY).union(found.suggestions.select(*_KEY)).distinct()
