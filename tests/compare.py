"""Compare a Spark result with SQL run by DuckDB on the same files: same columns, types and rows in any order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: pa.DataType) -> str:
    for name in ("boolean", "integer", "floating", "decimal", "date", "timestamp", "string", "large_string", "list"):
        if getattr(pa.types, f"is_{name}")(t):
            return "string" if name == "large_string" else "integer" if name == "integer" else name
    return "null" if pa.types.is_null(t) else str(t)


def _rows(table: pa.Table) -> pd.DataFrame:
    names = sorted(table.column_names)
    frame = pd.DataFrame({n: pd.Series([repr(_plain(v)) for v in table[n].to_pylist()], dtype=object) for n in names})
    return frame.sort_values(names).reset_index(drop=True) if names else frame


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def difference(result: DataFrame, sql: str, folder: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    got = result.toArrow()
    con = connect(folder)
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    kinds = {n: (_kind(got.schema.field(n).type), _kind(want.schema.field(n).type)) for n in got.column_names}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    a, b = _rows(got), _rows(want)
    unequal = (a != b).any(axis=1)
    if unequal.any():
        i = unequal.idxmax()
        cells = {n: (a[n][i], b[n][i]) for n in a.columns if a[n][i] != b[n][i]}
        return f"{unequal.sum()} of {len(a)} rows differ, first {str(cells)[:600]} types {odd}"
    return f"types {odd}" if odd else None
