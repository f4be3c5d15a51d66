"""The two jobs: a corpus to prompts, and responses to edited files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.defaults import IGNORE_GLOBS, MAX_CONTEXT_TOKENS, MAX_DISTANCE, SECRET_PATTERNS
from folioflow.functions.paths import components
from folioflow.functions.tokens import estimate_tokens
from folioflow.operators.applying import apply_hunk_lines, apply_proposed, apply_reports, verify_applied
from folioflow.operators.context import apply_budget, assemble_context, final_prompts, read_files
from folioflow.operators.extraction import extract_changes
from folioflow.operators.locating import locate_hunks
from folioflow.functions.text import sha1_content
from folioflow.operators.review import mixed_kinds
from folioflow.operators.selection import KEY, collect_files, drop_empty_init, drop_env_dirs, drop_ignored, drop_system
from folioflow.operators.skew import lookup_join, skew_join
from folioflow.session import kept
from folioflow.sources.filestore import FileStore


def build_prompts(
    files: DataFrame,
    instructions: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    ignore: Sequence[str] = IGNORE_GLOBS,
    secret_patterns: Sequence[str] = SECRET_PATTERNS,
    max_tokens: int = MAX_CONTEXT_TOKENS,
    enforce_budget: bool = False,
    skip_env: bool = True,
    skip_empty_init: bool = False,
    hide_system: bool = False,
    escape: str = "minimal",
    counter: Callable[[Column], Column] = estimate_tokens,
) -> DataFrame:
    """Select, redact, count, budget and render: prompt documents per project.

    Selection looks at paths only. `instructions` holds (project_id, instructions).
    """
    chosen = drop_env_dirs(files) if skip_env else files
    chosen = drop_system(chosen) if hide_system else chosen
    chosen = collect_files(drop_ignored(chosen, ignore), include, exclude)
    chosen = drop_empty_init(chosen) if skip_empty_init else chosen
    if not enforce_budget:
        return final_prompts(assemble_context(read_files(chosen, secret_patterns, counter), escape=escape), instructions)

    # Count every file, but carry content only for those that fit. What fits is the
    # start of each project in path order, so its last path tells, and no content is shuffled to find out.
    counted = read_files(chosen, secret_patterns, counter).select(*KEY, "tokens", "status")
    fitting = apply_budget(counted, max_tokens, enforce=True).filter(F.col("running_tokens") <= max_tokens)
    ends = fitting.groupBy("project_id").agg(F.max(components(F.col("rel_path"))).alias("_end"))
    within = lookup_join(chosen, kept(ends), ["project_id"], "inner", ["rel_path"])
    within = within.filter(components(F.col("rel_path")) <= F.col("_end")).drop("_end")
    read = read_files(within, secret_patterns, counter)
    # The native count gives at most seven characters a token.
    bound = 7 * max_tokens if counter is estimate_tokens else None
    contexts = assemble_context(read, escape=escape, max_chars=bound, prompts=chosen.select("project_id"))
    return final_prompts(contexts, instructions)


@dataclass
class EditResult:
    located: DataFrame
    reports: DataFrame
    new_files: DataFrame
    replaced: DataFrame
    # One content per file, with the checksum of what it was made from: for `publish_edits`.
    writes: DataFrame
    # Paths with changes of both kinds; nothing is applied in their projects.
    mixed: DataFrame
    rejects: DataFrame
    errors: DataFrame


def _writes(new_files: DataFrame, replaced: DataFrame) -> DataFrame:
    """(key, new_content, base_sha1): edited files, and of whole replacements of a file that of the last response."""
    newest = replaced.filter(F.col("new_content").isNotNull()).groupBy(*KEY).agg(F.max("response_id").alias("response_id"))
    last = replaced.join(newest, [*KEY, "response_id"]).dropDuplicates(KEY)
    return new_files.unionByName(last.select(*KEY, "new_content", "old_content")).select(
        *KEY, "new_content", sha1_content(F.col("old_content")).alias("base_sha1")
    )


def edit_files(responses: DataFrame, files: DataFrame, max_distance: float = MAX_DISTANCE) -> EditResult:
    """Extract, check kinds, locate and apply: new contents and one report per file.

    Where a path has hunks and whole replacements, nothing of its project is applied.
    The change records, their places and the reports are kept in reliable storage,
    because several results read them; they hold no file contents.
    """
    found = extract_changes(responses, keep=kept)
    kinds = found.hunks.select(*KEY, F.lit("hunk").alias("kind")).unionByName(found.suggestions.select(*KEY, F.lit("suggestion").alias("kind")))
    mixed = kept(mixed_kinds(kinds.distinct()))
    hunks, suggestions = found.hunks, found.suggestions
    if not mixed.isEmpty():
        blocked = mixed.select("project_id").distinct()
        hunks = skew_join(hunks, blocked, ["project_id"], "left_anti", ["response_id", "rel_path"])
        suggestions = skew_join(suggestions, blocked, ["project_id"], "left_anti", ["response_id", "rel_path"])
    located = kept(locate_hunks(hunks, files, max_distance))
    reports = kept(apply_reports(located, files))
    new_files = apply_hunk_lines(located, reports, files)
    replaced = verify_applied(apply_proposed(suggestions, files))
    return EditResult(
        located=located,
        reports=reports,
        new_files=new_files,
        replaced=replaced,
        writes=_writes(new_files, replaced),
        mixed=mixed,
        rejects=found.rejects,
        errors=found.errors,
    )


def publish_edits(result: EditResult, store: FileStore, stamp: str) -> DataFrame:
    """Commit the contents of an edit job and their backups as one version; its outcome per file.

    A final newline is ensured. What changed in the store since the job read it is
    skipped; files that the job itself did not write keep its report.
    """
    ended = F.when((F.col("new_content") == "") | F.col("new_content").endswith("\n"), F.col("new_content")).otherwise(F.concat("new_content", F.lit("\n")))
    written = store.publish(result.writes.withColumn("new_content", ended), stamp)
    rest = result.reports.filter(F.col("status") != "ok").select(*KEY, "status", F.lit(None).cast("long").alias("version"))
    return written.unionByName(rest)
