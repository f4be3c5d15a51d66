"""Context providers: named functions that give context files."""

from __future__ import annotations

import importlib.metadata
import warnings
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import escape_attr, is_blank
from folioflow.functions.tokens import estimate_tokens
from folioflow.schemas import CONTEXT_FILES, require_columns

Provider = Callable[[SparkSession, Mapping[str, object]], DataFrame]
ENTRY_POINTS = "folioflow.context_providers"
_PROVIDERS: dict[str, tuple[Provider, dict]] = {}


def register_provider(name: str, provider: Provider, options: dict | None = None) -> None:
    """Add a provider under a unique name; a later one replaces an earlier one."""
    if not name:
        raise ValueError("a provider needs a name")
    if not callable(provider):
        raise TypeError("a provider is a function of (spark, options)")
    if name in _PROVIDERS:
        warnings.warn(f"provider {name!r} is replaced")
    _PROVIDERS[name] = (provider, options or {})


def discover_providers(group: str = ENTRY_POINTS) -> list[str]:
    """Load providers that installed packages declare; known names are kept."""
    loaded = []
    for entry in importlib.metadata.entry_points(group=group):
        if entry.name in _PROVIDERS:
            continue
        try:
            register_provider(entry.name, entry.load())
            loaded.append(entry.name)
        except Exception as error:
            warnings.warn(f"provider {entry.name!r} could not be loaded: {error}")
    return loaded


def provider_names() -> list[str]:
    return list(_PROVIDERS)


def provider_options(name: str) -> dict:
    return _PROVIDERS[name][1]


def get_context(spark: SparkSession, name: str, options: Mapping[str, object] | None = None) -> DataFrame:
    """Context files of one provider, with the common columns only."""
    if name not in _PROVIDERS:
        raise KeyError(f"no provider {name!r}; known: {provider_names()}")
    provider, defaults = _PROVIDERS[name]
    given = {**{k: v.get("default") for k, v in defaults.items()}, **(options or {})}
    columns = CONTEXT_FILES.fieldNames()
    return require_columns(provider(spark, given), columns, f"provider {name!r}").select(*columns)


def union_contexts(*contexts: DataFrame) -> DataFrame:
    """Context files of several providers as one table."""
    columns = CONTEXT_FILES.fieldNames()
    return reduce(DataFrame.unionByName, [c.select(*columns) for c in contexts])


def diff_context(diffs: DataFrame) -> DataFrame:
    """Each diff text as one generated context file, plus its own `<context>` document.

    `diffs` holds (project_id, staged, diff_text).
    """
    name = F.when(F.col("staged"), "git_diff_staged.diff").otherwise("git_diff_unstaged.diff")
    text = F.col("diff_text")
    content = F.when(text.isNull() | is_blank(text), "<no changes detected>").otherwise(text)
    rows = diffs.select("project_id", name.alias("rel_path"), content.alias("content")).withColumns(
        {"tokens": estimate_tokens(F.col("content")), "status": F.lit("generated")}
    )
    document = F.concat(
        F.lit("<context>\n    <file name='"), F.col("rel_path"), F.lit("' path='"), escape_attr(F.col("project_id")),
        F.lit("' status='generated' tokens='"), F.col("tokens").cast("string"), F.lit("'>\n"),
        escape_attr(F.col("content")), F.lit("\n    </file>\n</context>"),
    )
    return rows.withColumn("context_xml", document)


def _git_diff(spark: SparkSession, options: Mapping[str, object]) -> DataFrame:
    diffs = options["diffs"]
    if isinstance(diffs, str):
        diffs = spark.read.parquet(diffs)
    return diff_context(diffs.filter(F.col("staged") == F.lit(bool(options["staged"]))))


register_provider(
    "git_diff",
    _git_diff,
    {
        "diffs": {"type": "table or path", "description": "Rows of (project_id, staged, diff_text)."},
        "staged": {"type": "boolean", "default": False, "description": "Staged changes instead of unstaged ones."},
    },
)
