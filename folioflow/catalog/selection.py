"""Queries of file selection and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.defaults import ENV_DIRS, SYSTEM_NAMES
from folioflow.functions.globs import glob_match
from folioflow.operators import selection as S
from folioflow.operators.context import read_files
from folioflow.operators.related import import_edges, related_files

_PATHS = ["project_id", "rel_path"]
_ENV = "[" + ", ".join(q.quoted(n) for n in ENV_DIRS) + "]"
_SYSTEM = "[" + ", ".join(q.quoted(n) for n in SYSTEM_NAMES) + "]"


@query("scan_files", f"""WITH {q.FILES}
SELECT project_id, rel_path, {q.base('rel_path')} AS name, {q.parent('rel_path')} AS parent_path, size, mtime_s FROM files""")
def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    return S.scan_files(fx.files(spark, folder))


@query("derive_nodes", f"""WITH {q.FILES}
SELECT project_id, path, {q.parent('path')} AS parent_path, {q.base('path')} AS name, bool_or(path <> rel_path) AS is_dir,
  CAST(len(string_split(path, '/')) AS BIGINT) AS depth
FROM (SELECT project_id, rel_path, unnest({q.prefixes('rel_path')}) AS path FROM files) GROUP BY project_id, path""")
def derive_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return S.derive_nodes(fx.files(spark, folder))


@query("drop_env_dirs", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM files WHERE NOT list_has_any(string_split(rel_path, '/')[1:-2], {_ENV})""")
def drop_env_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return S.drop_env_dirs(fx.files(spark, folder)).select(*_PATHS)


# System names put in front of, or in place of, a part of the path.
_SYSTEM_PATH = "CASE doc_id % 4 WHEN 0 THEN '.git/' || rel_path WHEN 1 THEN replace(rel_path, 'docs/', '.vscode/') WHEN 2 THEN rel_path || '/.DS_Store' ELSE rel_path END"


@query("drop_system", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM (SELECT project_id, {_SYSTEM_PATH} AS rel_path FROM files)
WHERE NOT list_has_any(string_split(rel_path, '/'), {_SYSTEM})""")
def drop_system(spark: SparkSession, folder: str) -> DataFrame:
    files = fx.files(spark, folder).selectExpr("project_id", f"{_SYSTEM_PATH} AS rel_path")
    return S.drop_system(files)


# Every document as the body of a package marker: code, comments, or docstrings around its text.
_INIT_BODY = """CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN '# ' || replace(text, chr(10), chr(10) || '  # ')
  WHEN 3 THEN '\"\"\"one line\"\"\"' || chr(10) || chr(10) || '# end' WHEN 4 THEN '\"\"\"' || chr(10) || text || chr(10) || '\"\"\"'
  WHEN 5 THEN '\"\"\"Open' || chr(10) || text || ' close\"\"\"' || chr(10) || 'x = 1' ELSE '''''' || text || chr(10) || '''''''' || chr(10) || text END"""
_STEP = """CASE WHEN a.found THEN a ELSE {'line': b.line, 'inside': b.inside <> a.inside,
  'found': b.line <> '' AND NOT b.passed AND NOT (b.inside <> a.inside) AND NOT starts_with(b.line, '#')} END"""


@query("drop_empty_init", f"""
WITH RECURSIVE bodies AS (SELECT doc_id, {_INIT_BODY} AS body FROM documents),
lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, {q.strip('parts[i]')} AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS parts FROM bodies))),
marked AS (SELECT *, starts_with(line, '\"\"\"') OR starts_with(line, '''''''') AS opens, ends_with(line, '\"\"\"') OR ends_with(line, '''''''') AS closes,
  len(regexp_extract_all(line, '\"\"\"')) % 2 = 1 OR len(regexp_extract_all(line, '''''''')) % 2 = 1 AS odd FROM lines),
flags AS (SELECT *, sum(CASE WHEN opens AND odd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM marked)
SELECT doc_id FROM flags WHERE line <> '' AND NOT (opens AND closes) AND NOT inside AND NOT starts_with(line, '#') GROUP BY doc_id""")
def drop_empty_init(spark: SparkSession, folder: str) -> DataFrame:
    bodies = fx.table(spark, folder, "documents").selectExpr("doc_id", "text")
    n, text, mark = F.col("doc_id") % 7, F.col("text"), F.lit('"""')
    body = (
        F.when(n == 0, "").when(n == 1, text).when(n == 2, F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n  # "))))
        .when(n == 3, '"""one line"""\n\n# end').when(n == 4, F.concat(mark, F.lit("\n"), text, F.lit("\n"), mark))
        .when(n == 5, F.concat(mark, F.lit("Open\n"), text, F.lit(' close"""\nx = 1')))
        .otherwise(F.concat(F.lit("''"), text, F.lit("\n'''\n"), text))
    )
    files = bodies.select("doc_id", body.alias("content"), F.lit("pkg/__init__.py").alias("rel_path"))
    return S.drop_empty_init(files).select("doc_id")


@query("drop_ignored", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM files WHERE NOT regexp_matches(rel_path, '(^|/)(build|env|\\.venv)/|\\.(log|pyc)$')""")
def drop_ignored(spark: SparkSession, folder: str) -> DataFrame:
    """The default globs; those that the sample paths can meet are in the check."""
    return S.drop_ignored(fx.files(spark, folder)).select(*_PATHS)


_GLOBS = {
    "any_py": ("*.py", r"^.*\.py$"), "nested_py": ("**/*.py", r"^.*/.*\.py$"), "below_src": ("src/*", r"^src/.*$"),
    "low_digit": ("d[0-4]*", r"^d[0-4].*$"), "not_d": ("[!d]*", r"^[^d].*$"), "slash_end": ("docs/", r"^docs/$"),
    "plain": ("tests", r"^tests$"), "second_is_1": ("?1*", r"^.1.*$"), "upper": ("*.PY", r"^.*\.PY$"),
}


@query("glob_match", f"WITH {q.FILES} SELECT project_id, rel_path, " + ", ".join(
    f"regexp_matches(rel_path, '{rx}') AS {name}" for name, (_, rx) in _GLOBS.items()
) + ", regexp_matches(rel_path, '(?i)^.*\\.PY$') AS upper_folded FROM files")
def glob_match_query(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("rel_path")
    return fx.files(spark, folder).select(
        *_PATHS, *[glob_match(path, [glob]).alias(name) for name, (glob, _) in _GLOBS.items()],
        glob_match(path, ["*.PY"], case_sensitive=False).alias("upper_folded"),
    )


# A file counts when it or a directory above it matches, by name or by path.
_INCLUDED = r"(\.md$|^src/pkg$|^src/pkg/|^tests$|^tests/|^docs/d1)"
_EXCLUDED = r"((^|/)d[0-9]*[05]\.[a-z]+$|(^|/)pkg(/|$))"


@query("include_filter", f"WITH {q.FILES} SELECT project_id, rel_path FROM files WHERE regexp_matches(rel_path, '{_INCLUDED}')")
def include_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.include_filter(fx.files(spark, folder), ["*.md", "src/pkg", "tests", "docs/d1*"]).select(*_PATHS)


@query("include_filter_top_level", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM files WHERE (project_id, string_split(rel_path, '/')[1]) IN (
  SELECT project_id, string_split(rel_path, '/')[1] FROM files WHERE regexp_matches(rel_path, '{_INCLUDED}'))""")
def include_filter_top_level(spark: SparkSession, folder: str) -> DataFrame:
    globs = ["*.md", "src/pkg", "tests", "docs/d1*"]
    return S.include_filter(fx.files(spark, folder), globs, "top_level").select(*_PATHS)


@query("exclude_filter", f"WITH {q.FILES} SELECT project_id, rel_path FROM files WHERE NOT regexp_matches(rel_path, '{_EXCLUDED}')")
def exclude_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.exclude_filter(fx.files(spark, folder), ["d*[05].*", "pkg"]).select(*_PATHS)


@query("exclude_filter_top_level", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM files WHERE NOT regexp_matches(string_split(rel_path, '/')[1], '^(docs|d.*[05]\\.[a-z]+)$')""")
def exclude_filter_top_level(spark: SparkSession, folder: str) -> DataFrame:
    return S.exclude_filter(fx.files(spark, folder), ["docs", "d*[05].*"], "top_level").select(*_PATHS)


@query("collect_files", f"""WITH {q.FILES}
SELECT project_id, rel_path FROM files WHERE regexp_matches(rel_path, '{_INCLUDED}') AND NOT regexp_matches(rel_path, '{_EXCLUDED}')""")
def collect_files(spark: SparkSession, folder: str) -> DataFrame:
    files = fx.files(spark, folder)
    return S.collect_files(files, ["*.md", "src/pkg", "tests", "docs/d1*"], ["d*[05].*", "pkg"]).select(*_PATHS)


_TICKED = f"{q.FILES}, ticked AS (SELECT *, lang = 'en' AS checked FROM files)"
_NODES = f"nodes AS (SELECT DISTINCT project_id, unnest({q.prefixes('rel_path')}) AS path FROM files)"


@query("text_filter", f"""WITH {q.FILES}, {_NODES}
SELECT DISTINCT project_id, unnest({q.prefixes('path')}) AS path FROM nodes WHERE contains(lower({q.base('path')}), 'd1')
UNION SELECT DISTINCT project_id, '' FROM files""")
def text_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.text_filter(fx.files(spark, folder), " D1 ")


@query("hide_unselected", f"""WITH {_TICKED}, {_NODES}
SELECT DISTINCT project_id, unnest({q.prefixes('path')}) AS path FROM nodes WHERE contains({q.base('path')}, 's')
  AND (project_id, path) IN (SELECT project_id, unnest({q.prefixes('rel_path')}) FROM ticked WHERE checked)
UNION SELECT DISTINCT project_id, '' FROM files""")
def hide_unselected(spark: SparkSession, folder: str) -> DataFrame:
    return S.hide_unselected(fx.ticked_files(spark, folder), text="s")


@query("selected_files", f"""WITH {_TICKED}
SELECT project_id, rel_path, size FROM ticked WHERE checked""")
def selected_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ticked paths plus one path per file that does not exist."""
    ticked = fx.ticked_files(spark, folder)
    selection = ticked.filter("checked").select(*_PATHS).union(
        ticked.select("project_id", F.concat("rel_path", F.lit(".gone")))
    )
    return S.selected_files(fx.files(spark, folder), selection).select(*_PATHS, "size")


@query("with_ancestors", f"""WITH {q.FILES}
SELECT project_id, rel_path, '' AS dir_path FROM files UNION ALL
SELECT project_id, rel_path, unnest(({q.prefixes('rel_path')})[1:-2]) AS dir_path FROM files""")
def with_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return S.with_ancestors(fx.files(spark, folder)).select(*_PATHS, "dir_path")


_DIRS = f"dirs AS (SELECT *, '' AS dir_path FROM ticked UNION ALL SELECT *, unnest(({q.prefixes('rel_path')})[1:-2]) FROM ticked)"


@query("dir_state", f"""WITH {_TICKED}, {_DIRS}
SELECT project_id, dir_path, CASE WHEN min(checked::INT) = 1 THEN 'checked' WHEN max(checked::INT) = 0 THEN 'unchecked' ELSE 'partial' END AS state
FROM dirs GROUP BY project_id, dir_path""")
def dir_state(spark: SparkSession, folder: str) -> DataFrame:
    return S.dir_state(fx.ticked_files(spark, folder))


@query("dir_tokens", f"""WITH {_TICKED}, {_DIRS}
SELECT project_id, dir_path, count(*) AS n_files, CAST(sum({q.tokens('content')}) AS BIGINT) AS tokens, CAST(sum(size) AS BIGINT) AS size
FROM dirs GROUP BY project_id, dir_path""")
def dir_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return S.dir_tokens(read_files(fx.files(spark, folder), []))


@query("tree_order", f"""WITH {q.FILES},
nodes AS (SELECT project_id, path, bool_or(path <> rel_path) AS is_dir FROM (
  SELECT project_id, rel_path, unnest({q.prefixes('rel_path')}) AS path FROM files) GROUP BY project_id, path)
SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY list_transform(string_split(path, '/'), lambda n, i:
  (CASE WHEN NOT is_dir AND i = len(string_split(path, '/')) THEN '1' ELSE '0' END) || lower(n) || chr(0) || n)) AS pos FROM nodes""")
def tree_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.tree_order(S.derive_nodes(fx.files(spark, folder))).select("project_id", "path", "pos")


@query("tree_order_blocks", f"""WITH {q.FILES},
nodes AS (SELECT project_id, path, bool_or(path <> rel_path) AS is_dir FROM (
  SELECT project_id, rel_path, unnest({q.prefixes('rel_path')}) AS path FROM files) GROUP BY project_id, path)
SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY list_transform(string_split(path, '/'), lambda n, i:
  (CASE WHEN NOT is_dir AND i = len(string_split(path, '/')) THEN '1' ELSE '0' END) || lower(n) || chr(0) || n)) AS pos FROM nodes""")
def tree_order_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same, by the way that very large projects take."""
    return S.tree_order(S.derive_nodes(fx.files(spark, folder)), max_group_rows=0).select("project_id", "path", "pos")


@query("tokens_on_nodes", f"""WITH {_TICKED},
nodes AS (SELECT project_id, path, bool_or(path <> rel_path) AS is_dir, any_value(doc_id) AS doc_id, any_value(lang) AS lang, any_value(content) AS content FROM (
  SELECT *, unnest({q.prefixes('rel_path')}) AS path FROM files) GROUP BY project_id, path)
SELECT project_id, path, CASE WHEN is_dir THEN '' WHEN lang <> 'en' THEN '-'
  ELSE format('{{:,}}', {q.tokens('content')}) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' (error)' END END AS token_text FROM nodes""")
def tokens_on_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Ticked files are measured; every second one stands for a read error."""
    measured = read_files(fx.ticked_files(spark, folder).filter("checked"), []).withColumn(
        "status", F.when(F.col("doc_id") % 2 == 0, F.col("status")).otherwise("read_error_not_found")
    )
    return S.tokens_on_nodes(S.derive_nodes(fx.files(spark, folder)), measured)


@query("latest_version", """
SELECT user_id, ts AS version, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    versions = fx.table(spark, folder, "events").select("user_id", F.col("ts").alias("version"), "event_id", "event_type")
    return S.latest_version(versions, ["user_id"])


@query("minus", f"""WITH {_TICKED}
SELECT project_id, rel_path FROM files EXCEPT SELECT project_id, rel_path FROM ticked WHERE checked""")
def minus(spark: SparkSession, folder: str) -> DataFrame:
    return S.minus(fx.files(spark, folder), fx.ticked_files(spark, folder).filter("checked")).select(*_PATHS)


_PATH_ORDER = f"""WITH {q.FILES}
SELECT project_id, rel_path, row_number() OVER (PARTITION BY project_id ORDER BY string_split(rel_path, '/')) AS pos FROM files"""


@query("path_order", _PATH_ORDER)
def path_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.path_order(fx.files(spark, folder))


@query("path_order_blocks", _PATH_ORDER)
def path_order_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same, by the way that very large projects take."""
    return S.path_order(fx.files(spark, folder), max_group_rows=0)


@query("related_files", f"""WITH {q.FILES},
turns AS (SELECT *, CASE WHEN lang = lag(lang) OVER (PARTITION BY project_id ORDER BY doc_id) THEN 0 ELSE 1 END AS turn FROM files),
chains AS (SELECT *, sum(turn) OVER (PARTITION BY project_id ORDER BY doc_id) AS chain FROM turns)
SELECT project_id, rel_path FROM chains WHERE (project_id, chain) IN (SELECT project_id, chain FROM chains WHERE size > 3000)""")
def related_files_query(spark: SparkSession, folder: str) -> DataFrame:
    """A file depends on the one before it in its project when both are in one language; large files are the seeds."""
    files = fx.files(spark, folder)
    earlier = files.select("project_id", "lang", F.col("rel_path").alias("dst"), (F.col("doc_id") + 20).alias("doc_id"))
    edges = files.select("project_id", "lang", F.col("rel_path").alias("src"), "doc_id").join(earlier, ["project_id", "lang", "doc_id"])
    return related_files(edges.select("project_id", "src", "dst"), files.filter("size > 3000").select(*_PATHS))


@query("import_edges", f"""WITH {q.FILES},
modules AS (SELECT project_id, min(rel_path) AS dst, replace(regexp_replace(rel_path, '(/__init__)?\\.py$', ''), '/', '.') AS module
  FROM files WHERE ends_with(rel_path, '.py') GROUP BY project_id, module)
SELECT f.project_id, f.rel_path AS src, m.dst FROM files f JOIN modules m ON m.project_id = f.project_id
  AND m.module = replace(regexp_replace(f.rel_path, '(/__init__)?\\.[a-z]+$', ''), '/', '.') WHERE f.rel_path <> m.dst
UNION SELECT f.project_id, f.rel_path, m.dst FROM files f JOIN modules m ON m.project_id = f.project_id AND m.module = 'd' || CAST(f.project_id[4:] AS BIGINT)
WHERE f.rel_path <> m.dst""")
def import_edges_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each file imports the module of its own name and the first module of its project."""
    own = F.replace(F.regexp_replace("rel_path", r"(?:/__init__)?\.[a-z]+\z", ""), F.lit("/"), F.lit("."))
    lines = F.concat(F.lit("import "), own, F.lit("\n  from d"), F.substring("project_id", 4, 9), F.lit(" import x\n"), F.col("content"))
    return import_edges(fx.files(spark, folder).withColumn("content", lines))
