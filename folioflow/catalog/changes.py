"""Queries of change extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.operators import extraction as E

_DIFF = """'--- a/' || rel_path || chr(10) || '+++ b/' || rel_path || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || array_to_string(hunk_lines, chr(10))"""
_AS_JSON = "'[{\"file\":\"' || rel_path || '\",\"hunk\":' || to_json(hunk_lines) || '}]'"
_RESPONSES = f"""{q.HUNKS},
responses AS (SELECT response_id, project_id, CASE response_id % 6 WHEN 0 THEN js WHEN 1 THEN 'The change:' || chr(10) || '```json' || chr(10) || js || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 2 THEN '<diff file="' || rel_path || '">' WHEN 3 THEN '```diff file="' || rel_path || '"' || chr(10) || '```' || chr(10) || 'type="proposed"'
  WHEN 4 THEN CASE WHEN response_id % 12 = 4 THEN '```json' || chr(10) || js[:-4] || chr(10) || '```' ELSE '<diff file="' || rel_path || '">' END ELSE content END AS text
FROM (SELECT *, {_AS_JSON} AS js FROM hunks))"""


@query("detect_format", f"""WITH {_RESPONSES}
SELECT response_id, CASE WHEN (starts_with(t, '{{') AND ends_with(t, '}}')) OR (starts_with(t, '[') AND ends_with(t, ']')) OR contains(t, '```json') THEN 'json'
  WHEN contains(t, '<diff file=') OR contains(t, '<proposed_content file=') THEN 'xml'
  WHEN contains(t, '```diff file=') AND contains(t, 'type="proposed"') THEN 'markdown' ELSE 'unknown' END AS format
FROM (SELECT response_id, {q.strip('text')} AS t FROM responses)""")
def detect_format(spark: SparkSession, folder: str) -> DataFrame:
    return fx.responses(spark, folder).select("response_id", E.detect_format(F.col("text")).alias("format"))


@query("response_formats", f"""WITH {q.HUNKS}
SELECT response_id, CASE response_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'xml' WHEN 3 THEN 'markdown'
  WHEN 4 THEN CASE WHEN response_id % 12 = 4 THEN 'unknown' ELSE 'xml' END ELSE 'unknown' END AS format FROM hunks""")
def response_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The format each response is read in, after JSON without valid items has fallen through."""
    return E.with_format(fx.responses(spark, folder)).select("response_id", "format")


@query("responses", "SELECT conv_id, turn, text FROM conversations WHERE lang_blank = FALSE".replace("lang_blank = FALSE", f"{q.strip('text')} <> ''")
       + f" UNION ALL SELECT conv_id, -1 - turn, '  ' || role FROM conversations")
def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns, padded ones and blank ones; the blank ones are dropped."""
    rows = fx.table(spark, folder, "conversations").select("conv_id", F.inline(fx.rows_of(
        ["turn", "text"],
        (F.col("turn"), F.col("text")), (-1 - F.col("turn"), F.concat(F.lit("  "), "role")), (F.col("turn") + 1000, "\n \u00a0"),
    )))
    return E.live_responses(rows)


@query("extract_json_hunks", f"""WITH {q.HUNKS}
SELECT response_id, project_id, rel_path, array_to_string(hunk_lines, chr(10)) AS body, array_to_string(cb, chr(10)) AS before, array_to_string(ca, chr(10)) AS after,
  CAST(1 AS BIGINT) AS lines_added, CAST(1 AS BIGINT) AS lines_deleted
FROM hunks WHERE response_id % 6 IN (0, 1)""")
def extract_json_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """What comes out of the responses is what the fixture put into them."""
    return E.extract_changes(fx.responses(spark, folder)).hunks.select(
        "response_id", "project_id", "rel_path", F.array_join("hunk_lines", "\n").alias("body"),
        F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"),
        "lines_added", "lines_deleted",
    )


# Items of every shape: two good ones in a document, and seven that are not hunks.
_ODD_ITEMS = [
    '{"file":7,"hunk":["+x"]}', '{"file":"a.py","hunk":["+x",3]}', '{"file":"a.py","hunk":"+x"}', '{"file":"","hunk":["+x"]}',
    '"just text"', "42", '{"hunk":["+x"]}',
]


@query("extract_json_items", f"""WITH {q.HUNKS}
SELECT response_id, CAST(0 AS INTEGER) AS hunk_pos, rel_path, array_to_string(hunk_lines, chr(10)) AS body, '' AS before FROM hunks
UNION ALL SELECT response_id, 1, 'b/' || rel_path, '', array_to_string(cb, chr(10)) FROM hunks""")
def extract_json_items(spark: SparkSession, folder: str) -> DataFrame:
    """Odd items are passed by; an integer context is ignored; `hunk_lines` stands in for an empty `hunk`."""
    rows = fx.hunks(spark, folder)
    good = F.to_json(F.struct(F.col("rel_path").alias("file"), F.col("hunk_lines").alias("hunk"), F.lit(3).alias("context_before")))
    empty = F.to_json(F.struct(
        F.concat(F.lit("b\\"), F.replace("rel_path", F.lit("/"), F.lit("\\"))).alias("file"), F.array().cast("array<string>").alias("hunk"),
        F.array().cast("array<string>").alias("hunk_lines"), "context_before",
    ))
    text = F.concat(F.lit("See [below]".replace("[", "(").replace("]", ")") + ": ["), good, F.lit(","), F.concat_ws(",", *map(F.lit, _ODD_ITEMS)), F.lit(","), empty, F.lit("]"))
    fenced = F.concat(F.lit("```json\n"), F.regexp_extract(text, r"(?s)(\[.*)", 1), F.lit("\n```"))
    found = E.extract_changes(rows.select("response_id", "project_id", fenced.alias("text"))).hunks
    # Positions count the objects with a file and a body: the good item, then the one with empty lists.
    return found.select(
        "response_id", F.col("hunk_pos").cast("int").alias("hunk_pos"), "rel_path", F.array_join("hunk_lines", "\n").alias("body"),
        F.array_join("context_before", "\n").alias("before"),
    )


@query("extract_json_repeated_keys", f"""WITH {q.HUNKS}
SELECT response_id, rel_path, array_to_string(hunk_lines, chr(10)) AS body FROM hunks""")
def extract_json_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A repeated key keeps its last value; the strict reader refuses it, the lenient one takes over."""
    rows = fx.hunks(spark, folder)
    one = F.to_json(F.struct(F.col("rel_path").alias("file"), F.col("hunk_lines").alias("hunk")))
    text = F.concat(F.lit('{"file":"first.py",'), F.substring(one, F.lit(2), F.length(one)))
    return E.extract_changes(rows.select("response_id", "project_id", text.alias("text"))).hunks.select(
        "response_id", "rel_path", F.array_join("hunk_lines", "\n").alias("body")
    )


def paired(kinds: str) -> str:
    return f"""WITH {q.HUNKS}
SELECT response_id, project_id, rel_path, {q.strip(_DIFF)} AS diff_text, {q.strip("content || chr(10) || 'last line'")} AS proposed_content,
  CAST(1 AS BIGINT) AS lines_added, CAST(1 AS BIGINT) AS lines_deleted
FROM hunks WHERE response_id % 6 IN ({kinds})"""


def _suggestions(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    records = E.change_records(fx.responses(spark, folder)).filter(F.col("format") == fmt)
    return E.Extracted(records).suggestions


@query("extract_xml_changes", paired("2"))
def extract_xml_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _suggestions(spark, folder, "xml")


@query("extract_markdown_changes", paired("3"))
def extract_markdown_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _suggestions(spark, folder, "markdown")


UNREADABLE = f"WITH {q.HUNKS} SELECT response_id, project_id FROM hunks WHERE response_id % 12 = 10"


@query("extract_errors", UNREADABLE)
def extract_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Responses whose XML cannot be read."""
    return E.extract_changes(fx.responses(spark, folder)).errors.select("response_id", "project_id")


# Per document: two diffs and two contents for one path, a content alone, and a diff alone.
_PIECES = """pieces AS (
SELECT doc_id AS response_id, source AS project_id, unnest(['a.py', 'a.py', 'a.py', 'a.py', 'new.py', 'old.py']) AS rel_path,
  unnest(['diff', 'diff', 'proposed', 'proposed', 'proposed', 'diff']) AS kind,
  unnest(['+old', '+' || text, 'old', text, text || '!', '-' || text]) AS body, unnest([0, 3, 1, 2, 4, 5]) AS pos FROM documents)"""


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return fx.table(spark, folder, "documents").select(
        F.col("doc_id").alias("response_id"), F.col("source").alias("project_id"),
        F.inline(fx.rows_of(
            ["rel_path", "kind", "body", "pos"],
            ("a.py", "diff", "+old", 0), ("a.py", "diff", F.concat(F.lit("+"), text), 3), ("a.py", "proposed", "old", 1),
            ("a.py", "proposed", text, 2), ("new.py", "proposed", F.concat(text, F.lit("!")), 4), ("old.py", "diff", F.concat(F.lit("-"), text), 5),
        )),
    )


@query("pair_diff_proposed", f"""WITH {_PIECES},
d AS (SELECT response_id, project_id, rel_path, max_by(body, pos) AS diff_text FROM pieces WHERE kind = 'diff' GROUP BY ALL),
p AS (SELECT response_id, project_id, rel_path, max_by(body, pos) AS proposed_content FROM pieces WHERE kind = 'proposed' GROUP BY ALL)
SELECT response_id, project_id, rel_path, coalesce(diff_text, '') AS diff_text, proposed_content FROM d FULL JOIN p USING (response_id, project_id, rel_path)""")
def pair_diff_proposed(spark: SparkSession, folder: str) -> DataFrame:
    return E.pair_diff_proposed(_pieces(spark, folder))


@query("last_per_path", f"""WITH {_PIECES}
SELECT response_id, project_id, rel_path, kind, max_by(body, pos) AS body, count(*) AS n_given FROM pieces GROUP BY response_id, project_id, rel_path, kind""")
def last_per_path(spark: SparkSession, folder: str) -> DataFrame:
    return E.last_per_path(_pieces(spark, folder))


REJECTED = f"""WITH {q.FILES}
SELECT doc_id AS response_id, project_id, '../' || rel_path AS file, 'outside project root' AS path_problem FROM files
UNION ALL SELECT doc_id, project_id, '/' || rel_path, 'absolute path' FROM files"""


def leaving_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Three hunks per response, two with a path that leaves the project."""
    path = F.col("rel_path")
    item = [F.struct(p.alias("file"), F.array(F.lit("+x")).alias("hunk")) for p in (path, F.concat(F.lit("../"), path), F.concat(F.lit("/"), path))]
    return fx.files(spark, folder).select(F.col("doc_id").alias("response_id"), "project_id", F.to_json(F.array(*item)).alias("text"))


@query("reject_paths", REJECTED)
def reject_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Changes whose path leaves the project are kept with the reason."""
    return E.extract_changes(leaving_responses(spark, folder)).rejects


@query("union_changes", f"""WITH {q.HUNKS}
SELECT response_id, rel_path, CASE WHEN response_id % 6 IN (0, 1) THEN 'hunk' ELSE 'suggestion' END AS kind, array_to_string(CASE WHEN response_id % 6 IN (0, 1) THEN hunk_lines END, chr(10)) AS body,
  CASE WHEN response_id % 6 IN (2, 3) THEN {q.strip("content || chr(10) || 'last line'")} END AS proposed_content
FROM hunks WHERE response_id % 6 IN (0, 1, 2, 3)""")
def union_changes(spark: SparkSession, folder: str) -> DataFrame:
    found = E.extract_changes(fx.responses(spark, folder))
    return E.union_changes(found.hunks, found.suggestions).select(
        "response_id", "rel_path", "kind", F.array_join("hunk_lines", "\n").alias("body"), "proposed_content"
    )
