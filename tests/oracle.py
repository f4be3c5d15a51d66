"""Run a registered query and its SQL side by side."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(table: pa.Table) -> Counter:
    table = table.select(sorted(table.column_names))
    columns = [c.to_pylist() for c in table.columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v
    return Counter(tuple(plain(v) for v in row) for row in zip(*columns))


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else str(t)


def compare(spark: SparkSession, folder: str, query, sql: str) -> str | None:
    """None if both agree, else what differs."""
    ours = query(spark, folder).toArrow()
    theirs = connect(folder).sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} against {sorted(theirs.column_names)}"
    kinds = {n: (_kind(ours.schema.field(n).type), _kind(theirs.schema.field(n).type)) for n in ours.column_names}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if odd:
        return f"types {odd}"
    a, b = _rows(ours), _rows(theirs)
    if a != b:
        extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{sum(a.values())} against {sum(b.values())} rows; only here {str(extra)[:700]}; only there {str(missing)[:700]}"
    return None if a else "no rows"
