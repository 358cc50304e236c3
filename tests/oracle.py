"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    kinds = [str(table.schema.field(n).type) for n in names]
    columns = [[normal(v) for v in table.column(n).to_pylist()] for n in names]
    rows = sorted(zip(*columns), key=repr) if columns else []
    return names, kinds, rows


def loose(kind: str) -> str:
    """Arrow spellings that hold the same values."""
    if kind.startswith("timestamp"):
        return "timestamp"
    return {"large_string": "string"}.get(kind, kind)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if names, types, row count and values agree."""
    s_names, s_kinds, s_rows = rows_of(spark_df.toArrow())
    result = con.execute(sql)
    table = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()
    o_names, o_kinds, o_rows = rows_of(table)
    out = []
    if s_names != o_names:
        return [f"columns: {s_names} against {o_names}"]
    for name, a, b in zip(s_names, s_kinds, o_kinds):
        if loose(a) != loose(b):
            out.append(f"type of {name}: {a} against {b}")
    if len(s_rows) != len(o_rows):
        out.append(f"rows: {len(s_rows)} against {len(o_rows)}")
    if s_rows != o_rows:
        only_s = sorted(set(map(repr, s_rows)) - set(map(repr, o_rows)))
        only_o = sorted(set(map(repr, o_rows)) - set(map(repr, s_rows)))
        out.append(f"values: {len(only_s)} / {len(only_o)} differ, e.g. {only_s[:2]} against {only_o[:2]}")
    return out
