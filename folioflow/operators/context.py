"""Files to `<context>` documents: reading, budgets and rendering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.defaults import MAX_CONTEXT_TOKENS, READ_NOT_FOUND, READ_OK, READ_SCRUBBED, SECRET_PATTERNS
from folioflow.functions.paths import base_name, components, module_label
from folioflow.functions.text import escape_attr, escape_content, once, redact_secrets
from folioflow.functions.tokens import estimate_tokens
from folioflow.operators.selection import KEY
from folioflow.operators.skew import running_total

MAX_PART_CHARS = 64 * 1024 * 1024


def read_status(selection: DataFrame, files: DataFrame) -> DataFrame:
    """Read status per selected path, missing files included."""
    found = files.select(*KEY, F.lit(READ_OK).alias("status"))
    return selection.join(found, KEY, "left").fillna(READ_NOT_FOUND, ["status"])


def read_files(
    files: DataFrame,
    patterns: Sequence[str] = SECRET_PATTERNS,
    counter: Callable[[Column], Column] = estimate_tokens,
) -> DataFrame:
    """Redact and count: adds `tokens` and `status`, replaces `content`."""
    clean = files.withColumn("_clean", once(redact_secrets(F.col("content"), patterns)))
    return (
        clean.withColumn("content", F.col("_clean.content"))
        .withColumn("status", F.when(F.col("_clean.scrubbed"), READ_SCRUBBED).otherwise(READ_OK))
        .drop("_clean")
        .withColumn("tokens", counter(F.col("content")))
    )


def total_tokens(context_files: DataFrame, prompt: str = "project_id") -> DataFrame:
    """Tokens and numbers of included and skipped files per prompt."""
    skipped = F.col("status").startswith("skipped")
    return context_files.groupBy(prompt).agg(
        F.count_if(~skipped).alias("n_included"),
        F.count_if(skipped).alias("n_skipped"),
        F.coalesce(F.sum(F.when(~skipped, F.col("tokens"))), F.lit(0)).cast("long").alias("total_tokens"),
    )


def apply_budget(
    context_files: DataFrame,
    max_tokens: int = MAX_CONTEXT_TOKENS,
    enforce: bool = False,
    prompt: str = "project_id",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Mark what the budget leaves out.

    By default everything is included and the budget only reported against.
    With `enforce`, the longest run of files in path order whose tokens fit is
    included and the rest get the status `skipped_budget`. Only paths and counts
    are ordered; contents, if the table has them, join back by their unique key.
    """
    if not enforce:
        return context_files
    key = [prompt, "rel_path"]
    wide = "content" in context_files.columns
    narrow = context_files.select(*key, "tokens") if wide else context_files
    ordered = narrow.withColumn("_parts", components(F.col("rel_path")))
    running = running_total(ordered, [prompt], ["_parts"], {"running_tokens": "tokens"}, max_group_rows).drop("_parts")
    if wide:
        running = context_files.join(running.drop("tokens"), key)
    over = F.col("running_tokens") > max_tokens
    return running.withColumn("status", F.when(over, "skipped_budget").otherwise(F.col("status")))


def file_record(files: DataFrame) -> DataFrame:
    """Name and module attribute of each file."""
    path = F.col("rel_path")
    return files.withColumns({"name": base_name(path), "module": module_label(path)})


def file_block(escape: str = "minimal") -> Column:
    """One `<file>` element of a context document."""
    path = F.col("rel_path")
    return F.concat(
        F.lit("    <file name='"), escape_attr(base_name(path)),
        F.lit("' module='"), escape_attr(module_label(path)), F.lit("'>\n"),
        escape_content(F.col("content"), escape), F.lit("\n    </file>"),
    )


def context_segments(context_files: DataFrame, prompt: str = "project_id", escape: str = "minimal") -> DataFrame:
    """The documents as ordered pieces, for prompts of any size.

    Concatenating `text` in the order (prompt, seq, parts) gives the document.
    No row is larger than one file, and a global sort spreads a large prompt
    over many tasks.
    """
    kept = context_files.filter(~F.col("status").startswith("skipped"))
    no_parts = F.array().cast("array<string>")
    prompts = context_files.select(prompt).distinct()

    def edge(seq: int, text: str) -> DataFrame:
        return prompts.select(prompt, F.lit(seq).alias("seq"), no_parts.alias("parts"), F.lit(text).alias("text"))

    body = kept.select(
        prompt, F.lit(1).alias("seq"), components(F.col("rel_path")).alias("parts"),
        F.concat(file_block(escape), F.lit("\n")).alias("text"),
    )
    return edge(0, "<context>\n").union(body).union(edge(2, "</context>"))


def assemble_context(
    context_files: DataFrame,
    prompt: str = "project_id",
    escape: str = "minimal",
    max_part_chars: int = MAX_PART_CHARS,
    max_group_rows: int | None = None,
    max_chars: int | None = None,
    prompts: DataFrame | None = None,
) -> DataFrame:
    """One `<context>` document per prompt, files in path order.

    A document is one row while its files hold at most `max_part_chars`
    characters; the columns `size` and key alone decide, unless the caller knows
    a bound `max_chars`. Larger documents become several rows, numbered by
    `part_no`, that concatenate to them; so no task gathers more than a part and
    nothing is left out. `prompts` names prompts that may have no file.
    """
    kept = context_files.filter(~F.col("status").startswith("skipped"))
    chars = F.col("size") if "size" in context_files.columns else F.length("content")
    largest = max_chars
    if largest is None:
        # Over all files, the skipped ones too: an upper bound that needs no content.
        largest = context_files.groupBy(prompt).agg(F.sum(chars).alias("n")).agg(F.max("n")).first()[0] or 0
    everyone = context_files if prompts is None else prompts
    last = everyone.groupBy(prompt).agg(F.lit(0).cast("long").alias("_last"))
    if largest <= max_part_chars:
        numbered = kept.withColumn("part_no", F.lit(0).cast("long"))
    else:
        key = [prompt, "rel_path"]
        narrow = kept.select(*key, chars.cast("long").alias("_n"), components(F.col("rel_path")).alias("_parts"))
        running = running_total(narrow, [prompt], ["_parts"], {"_upto": "_n"}, max_group_rows)
        part = F.floor((F.col("_upto") - F.col("_n")) / max_part_chars).cast("long")
        numbering = running.select(*key, part.alias("part_no"))
        numbered = kept.join(numbering, key)
        tops = numbering.groupBy(prompt).agg(F.max("part_no").alias("_top"))
        last = last.join(tops, prompt, "left").select(prompt, F.coalesce("_top", "_last").alias("_last"))

    pieces = numbered.groupBy(prompt, "part_no").agg(
        F.array_sort(
            F.collect_list(F.struct(components(F.col("rel_path")).alias("parts"), file_block(escape).alias("xml")))
        ).alias("_files"),
        F.count("*").alias("n_files"),
        F.sum("tokens").alias("total_tokens"),
    )
    # A prompt whose files are all skipped still has its (empty) document.
    pieces = last.join(pieces, prompt, "left").fillna(0, ["part_no", "n_files", "total_tokens"])
    blocks = F.transform(F.coalesce(F.col("_files"), F.array().cast(pieces.schema["_files"].dataType)), lambda f: f["xml"])
    return pieces.select(
        prompt,
        "part_no",
        F.concat(
            F.when(F.col("part_no") == 0, "<context>\n").otherwise(""),
            F.array_join(F.transform(blocks, lambda b: F.concat(b, F.lit("\n"))), ""),
            F.when(F.col("part_no") == F.col("_last"), "</context>").otherwise(""),
        ).alias("context_xml"),
        "n_files",
        "total_tokens",
    )


def final_prompts(contexts: DataFrame, instructions: DataFrame, prompt: str = "project_id") -> DataFrame:
    """Instructions, a blank line, then the context; instructions go before the first part."""
    joined = contexts.join(instructions, prompt, "left")
    lead = F.when((F.col("part_no") == 0) & F.col("instructions").isNotNull(), F.concat("instructions", F.lit("\n\n")))
    return joined.select(
        prompt, "part_no", F.concat(F.coalesce(lead, F.lit("")), F.col("context_xml")).alias("prompt_text"), "total_tokens"
    )
