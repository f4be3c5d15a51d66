"""Which files take part: ignore rules, globs, trees and tick marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.defaults import ENV_DIRS, IGNORE_GLOBS, READ_OK, READ_SCRUBBED, SYSTEM_NAMES
from folioflow.functions.globs import any_level_match, node_match
from folioflow.functions.paths import ancestors, base_name, components, dir_components, parent_path, prefixes
from folioflow.functions.text import let, strip, unify_newlines
from folioflow.operators.skew import running_rank, skew_join

KEY = ["project_id", "rel_path"]


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan_files(files: DataFrame) -> DataFrame:
    """File records of a corpus table: path, name, size and time, without content."""
    return files.select(
        *KEY, base_name(F.col("rel_path")).alias("name"), parent_path(F.col("rel_path")).alias("parent_path"),
        "size", "mtime_s",
    )


def drop_env_dirs(files: DataFrame, names: Sequence[str] = ENV_DIRS) -> DataFrame:
    """Without files below a virtual-environment directory."""
    return files.filter(~F.arrays_overlap(dir_components(F.col("rel_path")), _literal_array(names)))


def drop_system(files: DataFrame, names: Sequence[str] = SYSTEM_NAMES) -> DataFrame:
    """Without files that are, or lie below, a system name."""
    return files.filter(~F.arrays_overlap(components(F.col("rel_path")), _literal_array(names)))


def init_is_significant(content: Column) -> Column:
    """Whether an `__init__.py` holds code beyond comments and docstrings.

    Lines are read in order with one flag for being inside a docstring. A line
    that opens with triple quotes and holds an odd number of them turns the flag
    over, and a line that also ends with them is passed by.
    """
    triple_double, triple_single = '"""', "'''"

    def quotes(line: Column, mark: str) -> Column:
        return F.pmod(F.regexp_count(line, F.lit(mark)), F.lit(2)) == 1

    def step(state: Column, raw: Column) -> Column:
        def judge(line: Column) -> Column:
            opens = line.startswith(triple_double) | line.startswith(triple_single)
            closes = line.endswith(triple_double) | line.endswith(triple_single)
            odd = quotes(line, triple_double) | quotes(line, triple_single)
            inside = F.when(opens & odd, ~state["inside"]).otherwise(state["inside"])
            code = (line != "") & ~(opens & closes) & ~inside & ~line.startswith("#")
            return F.struct(inside.alias("inside"), (state["found"] | code).alias("found"))

        return F.when(state["found"], state).otherwise(let(strip(raw), judge))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("found"))
    lines = F.split(unify_newlines(content), "\n", -1)
    return F.aggregate(lines, start, step, lambda state: state["found"])


def drop_empty_init(files: DataFrame) -> DataFrame:
    """Without `__init__.py` files that hold no code."""
    is_init = base_name(F.col("rel_path")) == "__init__.py"
    return files.filter(F.when(is_init, init_is_significant(F.col("content"))).otherwise(F.lit(True)))


def drop_ignored(
    files: DataFrame, globs: Sequence[str] = IGNORE_GLOBS, case_sensitive: bool = True
) -> DataFrame:
    """Without files that match, or lie below a directory that matches, an ignore glob."""
    return files.filter(~any_level_match(F.col("rel_path"), globs, case_sensitive)) if globs else files


def _first_component() -> Column:
    return F.substring_index(F.col("rel_path"), "/", 1)


def include_filter(
    files: DataFrame, globs: Sequence[str], granularity: str = "file", case_sensitive: bool = True
) -> DataFrame:
    """Files that match, or lie below a directory that matches, an include glob.

    With `top_level`, one match keeps everything below its first path component.
    """
    if not globs:
        return files
    match = any_level_match(F.col("rel_path"), globs, case_sensitive)
    if granularity == "file":
        return files.filter(match)
    if granularity != "top_level":
        raise ValueError(f"unknown granularity {granularity!r}")
    named = files.withColumn("_top", _first_component())
    kept = named.filter(match).select("project_id", "_top").distinct()
    return skew_join(named, kept, ["project_id", "_top"], "left_semi", ["rel_path"]).drop("_top")


def exclude_filter(
    files: DataFrame, globs: Sequence[str], granularity: str = "file", case_sensitive: bool = True
) -> DataFrame:
    """Without files that match an exclude glob; `top_level` tests the first component only."""
    if not globs:
        return files
    if granularity == "file":
        return files.filter(~any_level_match(F.col("rel_path"), globs, case_sensitive))
    if granularity != "top_level":
        raise ValueError(f"unknown granularity {granularity!r}")
    return files.filter(~node_match(_first_component(), globs, case_sensitive))


def collect_files(
    files: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    granularity: str = "file",
    case_sensitive: bool = True,
) -> DataFrame:
    """Includes, then excludes."""
    kept = include_filter(files, include, granularity, case_sensitive)
    return exclude_filter(kept, exclude, granularity, case_sensitive)


def with_ancestors(files: DataFrame) -> DataFrame:
    """One row per file and directory above it, the root ('') included."""
    above = F.concat(F.array(F.lit("")), ancestors(F.col("rel_path")))
    return files.withColumn("dir_path", F.explode(above))


def derive_nodes(files: DataFrame) -> DataFrame:
    """The tree of each project as rows: every file and every directory above one."""
    nodes = files.select(
        "project_id",
        F.explode(
            let(
                prefixes(F.col("rel_path")),
                lambda p: F.transform(
                    p, lambda node, i: F.struct(node.alias("path"), (i < F.size(p) - 1).alias("is_dir"))
                ),
            )
        ).alias("node"),
    ).select("project_id", "node.*")
    path = F.col("path")
    return (
        nodes.groupBy("project_id", "path")
        .agg(F.max("is_dir").alias("is_dir"))
        .select(
            "project_id",
            "path",
            parent_path(path).alias("parent_path"),
            base_name(path).alias("name"),
            "is_dir",
            F.size(components(path)).cast("long").alias("depth"),
        )
    )


def dir_state(files: DataFrame, checked: str = "checked") -> DataFrame:
    """Tick state of every directory: checked, unchecked or partial."""
    flag = F.col(checked)
    return (
        with_ancestors(files)
        .groupBy("project_id", "dir_path")
        .agg(F.bool_and(flag).alias("_all"), F.bool_or(flag).alias("_any"))
        .select(
            "project_id",
            "dir_path",
            F.when(F.col("_all"), "checked").when(F.col("_any"), "partial").otherwise("unchecked").alias("state"),
        )
    )


def dir_tokens(files: DataFrame) -> DataFrame:
    """Files, tokens and bytes below every directory."""
    return (
        with_ancestors(files)
        .groupBy("project_id", "dir_path")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("tokens").alias("tokens"),
            F.sum("size").alias("size"),
        )
    )


def visible_nodes(files: DataFrame, text: str = "", hide_unselected: bool = False, checked: str = "checked") -> DataFrame:
    """Nodes a filtered tree shows: matches, everything above a match, and the root.

    `text` is sought in the node's own name, without case. With
    `hide_unselected`, a match must also be ticked, fully or in part.
    """
    needle = text.strip().lower()
    nodes = derive_nodes(files).select("project_id", "path", "name")
    if needle:
        nodes = nodes.filter(F.lower("name").contains(needle))
    if hide_unselected:
        ticked = files.filter(F.col(checked)).select(
            "project_id", F.explode(prefixes(F.col("rel_path"))).alias("path")
        ).distinct()
        nodes = nodes.join(ticked, ["project_id", "path"], "left_semi")
    shown = nodes.select("project_id", F.explode(prefixes(F.col("path"))).alias("path"))
    roots = files.select("project_id", F.lit("").alias("path"))
    return shown.union(roots).distinct()


def text_filter(files: DataFrame, text: str) -> DataFrame:
    return visible_nodes(files, text=text)


def hide_unselected(files: DataFrame, checked: str = "checked", text: str = "") -> DataFrame:
    return visible_nodes(files, text=text, hide_unselected=True, checked=checked)


def tree_key(path: Column, is_dir: Column) -> Column:
    """Sort key of a tree listing: directories first, then names without case."""
    return let(
        components(path),
        lambda parts: F.transform(
            parts,
            lambda name, i: F.struct(
                (~is_dir & (i == F.size(parts) - 1)).alias("is_file"), F.lower(name).alias("folded"), name.alias("name")
            ),
        ),
    )


def tree_order(nodes: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Nodes with their position in a pre-order listing of the project."""
    keyed = nodes.withColumn("_key", tree_key(F.col("path"), F.col("is_dir")))
    return running_rank(keyed, ["project_id"], ["_key"], "pos", max_group_rows).drop("_key")


def selected_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files that are selected; selected paths that do not exist drop out."""
    return files.join(selection.select(*KEY).distinct(), KEY, "left_semi")


def tokens_on_nodes(nodes: DataFrame, context_files: DataFrame) -> DataFrame:
    """Token text per file node: grouped digits, a short status when not read, `-` when not processed."""
    measured = context_files.select("project_id", F.col("rel_path").alias("path"), "tokens", "status")
    short = F.split_part(
        F.regexp_replace(F.col("status"), "read_|skipped_", ""), F.lit("_"), F.lit(1)
    )
    label = F.concat(
        F.format_number("tokens", 0),
        F.when(F.col("status").isin(READ_OK, READ_SCRUBBED, "included"), "").otherwise(
            F.concat(F.lit(" ("), short, F.lit(")"))
        ),
    )
    return nodes.join(measured, ["project_id", "path"], "left").select(
        "project_id",
        "path",
        F.when(F.col("is_dir"), "").when(F.col("status").isNull(), "-").otherwise(label).alias("token_text"),
    )


def latest_version(versions: DataFrame, key: Sequence[str] = KEY, version: str = "version") -> DataFrame:
    """Newest row per key; older results are dropped."""
    rest = [c for c in versions.columns if c not in key and c != version]
    newest = versions.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_newest"))
    return newest.select(*key, *[F.col(f"_newest.{c}").alias(c) for c in [version, *rest]])


def minus(kept: DataFrame, removed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows whose key is not among the removed ones."""
    return kept.join(removed.select(*key).distinct(), list(key), "left_anti")


def path_order(files: DataFrame, group: str = "project_id", max_group_rows: int | None = None) -> DataFrame:
    """Position of each file by component list."""
    keyed = files.select(group, "rel_path", components(F.col("rel_path")).alias("_parts"))
    return running_rank(keyed, [group], ["_parts"], "pos", max_group_rows).drop("_parts")
