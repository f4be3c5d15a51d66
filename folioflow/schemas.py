"""Table shapes shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FILES = _table(
    project_id=T.StringType(), rel_path=T.StringType(), content=T.StringType(),
    size=T.LongType(), mtime_s=T.LongType(),
)
CONTEXT_FILES = _table(
    project_id=T.StringType(), rel_path=T.StringType(), content=T.StringType(),
    tokens=T.LongType(), status=T.StringType(),
)
HUNKS = _table(
    response_id=T.LongType(), hunk_pos=T.IntegerType(), project_id=T.StringType(), rel_path=T.StringType(),
    hunk_lines=_STRINGS, context_before=_STRINGS, context_after=_STRINGS,
)
SUGGESTIONS = _table(
    response_id=T.LongType(), project_id=T.StringType(), rel_path=T.StringType(),
    diff_text=T.StringType(), proposed_content=T.StringType(),
)
RESPONSES = _table(response_id=T.LongType(), project_id=T.StringType(), text=T.StringType())
SNIPPET_CATALOGUE = _table(
    category=T.StringType(), cat_pos=T.IntegerType(), name=T.StringType(),
    item_pos=T.IntegerType(), text=T.StringType(),
)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Fail early, naming the columns that are absent."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the columns {absent}; it has {df.columns}")
    return df
