"""Hunk bodies and diff texts as line arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import rstrip, split_lines


def _added(line: Column, skip_headers: bool) -> Column:
    hit = line.startswith("+")
    return hit & ~line.startswith("+++") if skip_headers else hit


def _deleted(line: Column, skip_headers: bool) -> Column:
    hit = line.startswith("-")
    return hit & ~line.startswith("---") if skip_headers else hit


def line_changes(lines: Column, skip_headers: bool = False) -> Column:
    """Struct (added, deleted). Diff texts have `+++`/`---` headers, hunk arrays have none."""
    return F.struct(
        F.size(F.filter(lines, lambda line: _added(line, skip_headers))).cast("long").alias("added"),
        F.size(F.filter(lines, lambda line: _deleted(line, skip_headers))).cast("long").alias("deleted"),
    )


def diff_text_changes(diff_text: Column) -> Column:
    return line_changes(split_lines(diff_text), skip_headers=True)


def change_lines(lines: Column) -> Column:
    """Only the added and deleted lines, without CR and trailing space."""
    kept = F.filter(lines, lambda line: _added(line, True) | _deleted(line, True))
    return F.transform(kept, lambda line: rstrip(F.replace(line, F.lit("\r"), F.lit(""))))


def unmarked(line: Column) -> Column:
    """A hunk line without its leading marker."""
    return F.when(line.rlike(r"\A[-+ ]"), F.substring(line, F.lit(2), F.length(line))).otherwise(line)


def original_lines(before: Column, hunk_lines: Column, after: Column) -> Column:
    """What the file must hold: context, deleted and kept lines in order."""
    body = F.transform(F.filter(hunk_lines, lambda line: ~line.startswith("+")), unmarked)
    return F.concat(before, body, after)


def pure_addition(hunk_lines: Column) -> Column:
    return F.forall(hunk_lines, lambda line: line.startswith("+"))
