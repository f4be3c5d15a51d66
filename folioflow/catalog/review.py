"""Queries of change lists and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.operators import review as R
from folioflow.operators.locating import locate_hunks

_KEY = ["project_id", "rel_path"]
_ID = ["response_id", "hunk_pos"]

CHANGES = f"""{q.MANY_HUNKS},
changes AS (
SELECT response_id, hunk_pos, project_id, rel_path, 'hunk' AS kind, CAST(2 AS BIGINT) AS lines_added, CAST(1 AS BIGINT) AS lines_deleted,
  ['matched', 'unmatched', 'accepted', 'rejected', 'pending'][CAST((response_id + hunk_pos) % 5 + 1 AS BIGINT)] AS status, NULL AS proposed_content FROM hunks
UNION ALL SELECT doc_id, NULL, project_id, CASE WHEN project_id = 'src2' THEN rel_path ELSE rel_path || '.whole' END, 'suggestion', size % 7, size % 3,
  CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'accepted' END, CASE WHEN doc_id % 3 <> 0 THEN content END FROM files),
shown AS (SELECT * FROM changes WHERE status IN ('pending', 'matched', 'unmatched')),
mixed AS (SELECT project_id, rel_path FROM changes GROUP BY project_id, rel_path HAVING count(DISTINCT kind) > 1),
ready AS (SELECT * FROM changes WHERE ((kind = 'hunk' AND status = 'matched') OR (kind = 'suggestion' AND status = 'pending' AND proposed_content IS NOT NULL))
  AND project_id NOT IN (SELECT project_id FROM mixed))"""


@query("reviewable", f"WITH {CHANGES} SELECT response_id, hunk_pos, project_id, rel_path, status FROM shown")
def reviewable(spark: SparkSession, folder: str) -> DataFrame:
    return R.reviewable(fx.changes(spark, folder)).select(*_ID, *_KEY, "status")


@query("reject_all", f"""WITH {CHANGES}
SELECT response_id, hunk_pos, rel_path, CASE WHEN status = 'accepted' THEN status ELSE 'rejected' END AS status FROM changes""")
def reject_all(spark: SparkSession, folder: str) -> DataFrame:
    return R.reject_all(fx.changes(spark, folder)).select(*_ID, "rel_path", "status")


@query("mixed_kinds", f"WITH {CHANGES} SELECT project_id, rel_path FROM mixed")
def mixed_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return R.mixed_kinds(fx.changes(spark, folder))


@query("applicable", f"WITH {CHANGES} SELECT response_id, hunk_pos, project_id, rel_path, kind FROM ready")
def applicable(spark: SparkSession, folder: str) -> DataFrame:
    return R.applicable(fx.changes(spark, folder)).select(*_ID, *_KEY, "kind")


@query("applicable_counts", f"""WITH {CHANGES}
SELECT project_id, count(*) FILTER (kind = 'hunk') AS n_hunks, count(DISTINCT rel_path) FILTER (kind = 'hunk') AS n_hunk_files,
  count(*) FILTER (kind = 'suggestion') AS n_suggestions FROM ready GROUP BY project_id""")
def applicable_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.applicable_counts(fx.changes(spark, folder))


@query("change_summary", f"""WITH {CHANGES}
SELECT project_id, count(DISTINCT rel_path) AS n_files, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted FROM shown GROUP BY project_id""")
def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return R.change_summary(fx.changes(spark, folder))


_SORTS = {
    "path": "rel_path", "changes_asc": "lines_added + lines_deleted, rel_path", "changes_desc": "lines_added + lines_deleted DESC, rel_path DESC",
}


def _ordered(order: str) -> str:
    return f"""WITH {CHANGES}
SELECT response_id, hunk_pos, rel_path, row_number() OVER (PARTITION BY project_id ORDER BY {_SORTS[order]}, response_id, hunk_pos NULLS FIRST) AS pos FROM shown"""


@query("change_order", _ordered("changes_desc"))
def change_order(spark: SparkSession, folder: str) -> DataFrame:
    return R.change_order(fx.changes(spark, folder)).select(*_ID, "rel_path", "pos")


@query("change_order_by_path", _ordered("path"))
def change_order_by_path(spark: SparkSession, folder: str) -> DataFrame:
    return R.change_order(fx.changes(spark, folder), "path").select(*_ID, "rel_path", "pos")


@query("change_order_ascending", _ordered("changes_asc"))
def change_order_ascending(spark: SparkSession, folder: str) -> DataFrame:
    return R.change_order(fx.changes(spark, folder), "changes_asc", max_group_rows=0).select(*_ID, "rel_path", "pos")


@query("item_index", f"""WITH {CHANGES}
SELECT response_id, hunk_pos, rel_path, row_number() OVER (PARTITION BY project_id, rel_path ORDER BY response_id, hunk_pos NULLS FIRST) AS item,
  count(*) OVER (PARTITION BY project_id, rel_path) AS n_items FROM shown""")
def item_index(spark: SparkSession, folder: str) -> DataFrame:
    return R.item_index(fx.changes(spark, folder)).select(*_ID, "rel_path", "item", "n_items")


@query("change_label", f"""WITH {CHANGES}
SELECT response_id, hunk_pos, rel_path, rtrim('(+' || lines_added || ' / -' || lines_deleted || ') ' || CASE WHEN status = 'unmatched' THEN '[Cannot Locate]'
  WHEN status = 'matched' THEN '[Located]' WHEN ends_with(rel_path, '.whole') THEN '[New File]' ELSE '' END) AS label,
  CASE WHEN status = 'unmatched' THEN 'unmatched' WHEN ends_with(rel_path, '.whole') AND status IN ('pending', 'matched') THEN 'new_file' ELSE 'default' END AS colour FROM shown""")
def change_label(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions under a new name are for new files."""
    shown = R.reviewable(fx.changes(spark, folder))
    labels = R.change_label(F.col("status"), F.col("rel_path").endswith(".whole"), F.col("lines_added"), F.col("lines_deleted"))
    return shown.withColumns(labels).select(*_ID, "rel_path", "label", "colour")


# The preview as rows: lines before, the hunk, and lines after it; or a note.
_PREVIEW = f"""WITH {q.HUNKS}, {q.LOCATED},
placed AS (SELECT *, start + len(cb) AS body FROM located),
rows AS (SELECT response_id, CASE WHEN start IS NULL THEN
    [{{'label': 'error-message', 'text': 'No place in the file fits this hunk.'}}, {{'label': 'error-message', 'text': 'The file may hold something else by now.'}},
     {{'label': 'error-message', 'text': 'The hunk is left out.'}}]
  ELSE list_concat(
    list_transform(L[1:start], lambda x: {{'label': 'file-context', 'text': x}}), list_transform(L[start + 1:body], lambda x: {{'label': 'hunk-context-before', 'text': x}}),
    [{{'label': 'hunk-deleted', 'text': hunk_lines[1][2:]}}, {{'label': 'hunk-added', 'text': hunk_lines[2][2:]}}],
    list_transform(L[body + 2:body + 1 + len(ca)], lambda x: {{'label': 'hunk-context-after', 'text': x}}), list_transform(L[body + 2 + len(ca):], lambda x: {{'label': 'file-context', 'text': x}})) END AS rows FROM placed)"""
_TEXT = f"CASE WHEN r.text = '' THEN ' ' ELSE {q.escape_all('r.text')} END"


@query("annotate_hunk", f"""{_PREVIEW}
SELECT response_id, line_no, r.label AS label, {_TEXT} AS text FROM (SELECT response_id, unnest(rows) AS r, CAST(unnest(range(0, len(rows))) AS BIGINT) AS line_no FROM rows)""")
def annotate_hunk(spark: SparkSession, folder: str) -> DataFrame:
    located = locate_hunks(fx.hunks(spark, folder), fx.files(spark, folder))
    return R.annotate_hunk(located, fx.files(spark, folder)).select("response_id", "line_no", "label", "text")


@query("hunk_html", f"""{_PREVIEW}
SELECT response_id, '<pre>' || chr(10) || array_to_string(list_transform(rows, lambda r: '<span class="' || r.label || '">' || {_TEXT} || '</span>'), chr(10)) || chr(10) || '</pre>' AS html FROM rows""")
def hunk_html(spark: SparkSession, folder: str) -> DataFrame:
    located = locate_hunks(fx.hunks(spark, folder), fx.files(spark, folder))
    return R.hunk_html(located, fx.files(spark, folder)).select("response_id", "html")


_DIFF = """CASE WHEN doc_id % 7 = 3 THEN '@@ no newline @@' ELSE '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || 'python' || chr(10) || '+' || replace(text, chr(10), chr(10) || '-') END"""
_ROWS = f"""diffs AS (SELECT doc_id AS response_id, CASE WHEN doc_id % 7 = 3 THEN
    [{{'label': 'error-message', 'text': 'This diff has no lines to show.'}}, {{'label': 'error-message', 'text': 'Its text marks changes but does not break lines.'}}]
  ELSE list_transform(list_filter(string_split({_DIFF}, chr(10)), lambda l: l <> 'python'), lambda l: {{'label':
    CASE WHEN starts_with(l, '+') AND NOT starts_with(l, '+++') THEN 'diff-add' WHEN starts_with(l, '-') AND NOT starts_with(l, '---') THEN 'diff-del'
      WHEN starts_with(l, '@@') OR starts_with(l, '---') OR starts_with(l, '+++') THEN 'diff-header' ELSE 'diff-context' END, 'text': l}}) END AS rows FROM documents)"""


def _diffs(spark: SparkSession, folder: str) -> DataFrame:
    body = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\npython\n+"), F.replace("text", F.lit("\n"), F.lit("\n-")))
    return fx.table(spark, folder, "documents").select(
        F.col("doc_id").alias("response_id"), F.col("source").alias("project_id"), F.lit("x").alias("rel_path"),
        F.when(F.col("doc_id") % 7 == 3, "@@ no newline @@").otherwise(body).alias("diff_text"), F.lit(None).cast("string").alias("proposed_content"),
    )


@query("annotate_diff", f"""WITH {_ROWS}
SELECT response_id, line_no, r.label AS label, {_TEXT} AS text FROM (SELECT response_id, unnest(rows) AS r, CAST(unnest(range(0, len(rows))) AS BIGINT) AS line_no FROM diffs)""")
def annotate_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a diff with headers, a copy artefact, and lines added or deleted."""
    return R.annotate_diff(_diffs(spark, folder)).select("response_id", "line_no", "label", "text")


@query("diff_html", f"""WITH {_ROWS}
SELECT response_id, '<pre>' || chr(10) || array_to_string(list_transform(rows, lambda r: '<span class="' || r.label || '">' || {_TEXT} || '</span>'), chr(10)) || chr(10) || '</pre>' AS html FROM diffs""")
def diff_html(spark: SparkSession, folder: str) -> DataFrame:
    return _diffs(spark, folder).select("response_id", R.diff_html(F.col("diff_text"), F.col("proposed_content")).alias("html"))
