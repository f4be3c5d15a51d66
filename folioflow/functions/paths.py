"""Relative paths as component lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let


def components(path: Column) -> Column:
    """Component list; its ordering is path order (`a/b` before `a-b/c`)."""
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Directory part, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def dir_components(path: Column) -> Column:
    return let(components(path), lambda parts: F.slice(parts, 1, F.size(parts) - 1))


def prefixes(path: Column) -> Column:
    """Every ancestor and the path itself, outermost first."""
    return let(
        components(path),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
        ),
    )


def ancestors(path: Column) -> Column:
    """Every directory above the path, outermost first; none for a root file."""
    return let(prefixes(path), lambda p: F.slice(p, 1, F.size(p) - 1))


def module_label(path: Column) -> Column:
    """Directory with back-slashes and a trailing one."""
    parent = parent_path(path)
    return F.concat(F.replace(parent, F.lit("/"), F.lit("\\")), F.lit("\\"))


def resolve_path(path: Column) -> Column:
    """Struct (rel_path, reason): `.`/`..` folded; reason set when it leaves the root."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("escaped"))

    def step(acc: Column, part: Column) -> Column:
        kept, depth = acc["kept"], F.size(acc["kept"])
        return (
            F.when(part.isin("", "."), acc)
            .when(
                part == "..",
                F.struct(
                    F.slice(kept, F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("kept"),
                    (acc["escaped"] | (depth == 0)).alias("escaped"),
                ),
            )
            .otherwise(F.struct(F.concat(kept, F.array(part)).alias("kept"), acc["escaped"].alias("escaped")))
        )

    folded = F.aggregate(F.split(slashed, "/", -1), start, step)
    return let(
        folded,
        lambda f: F.struct(
            F.array_join(f["kept"], "/").alias("rel_path"),
            F.when(path.isNull() | (path == ""), F.lit("empty path"))
            .when(slashed.rlike(r"\A(?:/|[A-Za-z]:)"), F.lit("absolute path"))
            .when(f["escaped"], F.lit("outside project root"))
            .when(F.size(f["kept"]) == 0, F.lit("names the root"))
            .alias("reason"),
        ),
    )


def backup_path(path: Column, stamp: Column) -> Column:
    """backups/<dir>/<stem>_<stamp><suffix>; a leading dot is part of the stem."""
    name = base_name(path)
    suffix = F.regexp_extract(name, r"\A.+(\.[^.]+)\z", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    parent = parent_path(path)
    folder = F.when(parent == "", F.lit("backups/")).otherwise(F.concat(F.lit("backups/"), parent, F.lit("/")))
    return F.concat(folder, stem, F.lit("_"), stamp, suffix)
