"""Queries of context documents and whole prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.instructions import INSTRUCTIONS_SQL, project_instructions
from folioflow.catalog.registry import query
from folioflow.functions.tokens import bpe_tokens
from folioflow.operators import context as C
from folioflow.plans import build_prompts
from folioflow.sources.providers import diff_context, get_context, union_contexts

_PATTERNS = [q.TOKEN_PATTERN]
_LIMIT = 8192


@query("read_status", f"""WITH {q.FILES}
SELECT project_id, rel_path, 'read_ok' AS status FROM files UNION ALL
SELECT project_id, rel_path || '.gone', 'read_error_not_found' FROM files""")
def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every file and one missing path beside it."""
    files = fx.files(spark, folder)
    paths = files.select("project_id", F.explode(F.array("rel_path", F.concat("rel_path", F.lit(".gone")))).alias("rel_path"))
    return C.read_status(paths, files)


@query("total_tokens", f"""WITH {q.FILES}, {q.READ}
SELECT project_id, count(*) AS n_included, CAST(0 AS BIGINT) AS n_skipped, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM read_files GROUP BY project_id""")
def total_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The budget as it stands by default: everything is included and added up."""
    return C.total_tokens(C.apply_budget(C.read_files(fx.files(spark, folder), _PATTERNS)))


_RUNNING = f"""running AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY project_id ORDER BY string_split(rel_path, '/')) AS BIGINT) AS running_tokens FROM read_files)"""
_BUDGET = f"""WITH {q.FILES}, {q.READ}, {_RUNNING}
SELECT project_id, rel_path, tokens, running_tokens, CASE WHEN running_tokens > {_LIMIT} THEN 'skipped_budget' ELSE status END AS status FROM running"""


@query("apply_budget", _BUDGET)
def apply_budget(spark: SparkSession, folder: str) -> DataFrame:
    read = C.read_files(fx.files(spark, folder), _PATTERNS)
    return C.apply_budget(read, _LIMIT, enforce=True).select("project_id", "rel_path", "tokens", "running_tokens", "status")


@query("apply_budget_blocks", _BUDGET)
def apply_budget_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same, by the way that very large projects take."""
    read = C.read_files(fx.files(spark, folder), _PATTERNS)
    return C.apply_budget(read, _LIMIT, enforce=True, max_group_rows=0).select(
        "project_id", "rel_path", "tokens", "running_tokens", "status"
    )


_MODULE = f"replace(regexp_replace(rel_path, '[^/]*$', ''), '/', chr(92)) || CASE WHEN contains(rel_path, '/') THEN '' ELSE chr(92) END"
_BLOCK = f"""'    <file name=''' || {q.escape_all(q.base('rel_path'))} || ''' module=''' || {q.escape_all(_MODULE)} || '''>' || chr(10)
  || {q.escape_some('content')} || chr(10) || '    </file>' || chr(10)"""


@query("assemble_context", f"""WITH {q.FILES}, {q.READ}
SELECT project_id, CAST(0 AS BIGINT) AS part_no, '<context>' || chr(10) || string_agg({_BLOCK}, '' ORDER BY string_split(rel_path, '/')) || '</context>' AS context_xml,
  count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM read_files GROUP BY project_id""")
def assemble_context(spark: SparkSession, folder: str) -> DataFrame:
    return C.assemble_context(C.read_files(fx.files(spark, folder), _PATTERNS))


_PART = 20_000


@query("assemble_context_parts", f"""WITH {q.FILES}, {q.READ},
parts AS (SELECT *, CAST((sum(size) OVER (PARTITION BY project_id ORDER BY string_split(rel_path, '/')) - size) // {_PART} AS BIGINT) AS part_no FROM read_files),
tops AS (SELECT project_id, max(part_no) AS top FROM parts GROUP BY project_id)
SELECT project_id, part_no, CASE WHEN part_no = 0 THEN '<context>' || chr(10) ELSE '' END || string_agg({_BLOCK}, '' ORDER BY string_split(rel_path, '/'))
  || CASE WHEN part_no = any_value(top) THEN '</context>' ELSE '' END AS context_xml, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens
FROM parts JOIN tops USING (project_id) GROUP BY project_id, part_no""")
def assemble_context_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents larger than a part, as parts that concatenate to them."""
    read = C.read_files(fx.files(spark, folder), _PATTERNS)
    return C.assemble_context(read, max_part_chars=_PART, max_group_rows=0)


@query("context_segments", f"""WITH {q.FILES}, {q.READ},
segments AS (SELECT project_id, 1 AS seq, rel_path, {_BLOCK} AS text FROM read_files
  UNION ALL SELECT DISTINCT project_id, 0, '', '<context>' || chr(10) FROM files UNION ALL SELECT DISTINCT project_id, 2, '', '</context>' FROM files)
SELECT project_id, seq, rel_path AS path, text FROM segments""")
def context_segments(spark: SparkSession, folder: str) -> DataFrame:
    segments = C.context_segments(C.read_files(fx.files(spark, folder), _PATTERNS))
    return segments.select("project_id", "seq", F.array_join("parts", "/").alias("path"), "text")


_CHOSEN = r"NOT regexp_matches(rel_path, '(^|/)(build|env|\.venv)/|\.(log|pyc)$') AND regexp_matches(rel_path, '\.(py|md)$') AND NOT regexp_matches(rel_path, '^tests/')"


def _prompts_sql(limit: int | None) -> str:
    kept = "status NOT LIKE 'skipped%'"
    over = "FALSE" if limit is None else f"running_tokens > {limit}"
    return f"""WITH {q.FILES}, {q.READ},
chosen AS (SELECT * FROM read_files WHERE {_CHOSEN}),
budgeted AS (SELECT * EXCLUDE (status), CASE WHEN {over} THEN 'skipped_budget' ELSE status END AS status FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY project_id ORDER BY string_split(rel_path, '/')) AS running_tokens FROM chosen)),
contexts AS (SELECT project_id, '<context>' || chr(10) || coalesce(string_agg({_BLOCK}, '' ORDER BY string_split(rel_path, '/')) FILTER ({kept}), '') || '</context>' AS context_xml,
  CAST(coalesce(sum(tokens) FILTER ({kept}), 0) AS BIGINT) AS total_tokens FROM budgeted GROUP BY project_id),
{INSTRUCTIONS_SQL}
SELECT project_id, CAST(0 AS BIGINT) AS part_no, instructions || chr(10) || chr(10) || context_xml AS prompt_text, total_tokens
FROM contexts JOIN instructions ON prompt_id = project_id"""


def _prompts(spark: SparkSession, folder: str, enforce: bool) -> DataFrame:
    return build_prompts(
        fx.files(spark, folder), project_instructions(spark, folder), include=["*.py", "*.md"], exclude=["tests"],
        secret_patterns=_PATTERNS, max_tokens=2000, enforce_budget=enforce,
    )


@query("build_prompts", _prompts_sql(2000))
def build_prompts_query(spark: SparkSession, folder: str) -> DataFrame:
    """The whole first job: one prompt per project within its token budget."""
    return _prompts(spark, folder, enforce=True)


@query("write_prompts", _prompts_sql(None))
def write_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the prompt sink writes, without a limit on tokens."""
    return _prompts(spark, folder, enforce=False)


# Each document as a diff of its project; some are blank.
_DIFFS = "diffs AS (SELECT doc_id || ' & ' || source AS project_id, lang = 'en' AS staged, CASE WHEN doc_id % 9 = 4 THEN ' ' || chr(10) ELSE text END AS diff_text FROM documents)"
_DIFF_CONTEXT = f"""generated AS (SELECT project_id, CASE WHEN staged THEN 'git_diff_staged.diff' ELSE 'git_diff_unstaged.diff' END AS rel_path,
  CASE WHEN {q.strip('diff_text')} = '' THEN '<no changes detected>' ELSE diff_text END AS content, 'generated' AS status FROM diffs)"""


def _diffs(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "documents").selectExpr(
        "concat(doc_id, ' & ', source) AS project_id", "lang = 'en' AS staged",
        "CASE WHEN doc_id % 9 = 4 THEN concat(' ', chr(10)) ELSE text END AS diff_text",
    )


@query("diff_context", f"""WITH {_DIFFS}, {_DIFF_CONTEXT}
SELECT project_id, rel_path, content, {q.tokens('content')} AS tokens, status, '<context>' || chr(10) || '    <file name=''' || rel_path || ''' path=''' || {q.escape_all('project_id')}
  || ''' status=''generated'' tokens=''' || {q.tokens('content')} || '''>' || chr(10) || {q.escape_all('content')} || chr(10) || '    </file>' || chr(10) || '</context>' AS context_xml
FROM generated""")
def diff_context_query(spark: SparkSession, folder: str) -> DataFrame:
    return diff_context(_diffs(spark, folder))


@query("context_provider", f"""WITH {_DIFFS}, {_DIFF_CONTEXT}
SELECT project_id, rel_path, content, {q.tokens('content')} AS tokens, status FROM generated WHERE rel_path = 'git_diff_staged.diff'""")
def context_provider(spark: SparkSession, folder: str) -> DataFrame:
    """A registered provider, called by name with options."""
    return get_context(spark, "git_diff", {"diffs": _diffs(spark, folder), "staged": True})


@query("union_contexts", f"""WITH {q.FILES}, {q.READ}, {_DIFFS}, {_DIFF_CONTEXT}
SELECT project_id, rel_path, content, tokens, status FROM read_files
UNION ALL SELECT project_id, rel_path, content, {q.tokens('content')}, status FROM generated""")
def union_contexts_query(spark: SparkSession, folder: str) -> DataFrame:
    return union_contexts(C.read_files(fx.files(spark, folder), _PATTERNS), diff_context(_diffs(spark, folder)))


@query("exact_tokens")
def exact_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a named encoding; estimates where its vocabulary is not at hand, so no SQL can say which."""
    return fx.table(spark, folder, "documents").select("doc_id", bpe_tokens(F.col("text"), "cl100k_base").alias("tokens"))
