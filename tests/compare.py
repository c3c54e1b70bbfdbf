"""Row-by-row comparison of a Spark result with the DuckDB result of its SQL form."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    rows = [tuple(repr(v) for v in row) for row in zip(*[c.to_pylist() for c in table.columns])]
    return sorted(rows)


def _kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp" + ("_tz" if t.tz else "")
    return "string" if pa.types.is_large_string(t) else str(t)


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    found = []
    a = {f.name: _kind(f.type) for f in spark_table.schema}
    b = {f.name: _kind(f.type) for f in sql_table.schema}
    if a != b:
        odd = {n: (a.get(n), b.get(n)) for n in {*a, *b} if a.get(n) != b.get(n)}
        found.append(f"columns differ: {odd}")
    if set(a) == set(b):
        left, right = canonical(spark_table), canonical(sql_table)
        if len(left) != len(right):
            found.append(f"rows: {len(left)} and {len(right)}")
        if left != right:
            in_left, in_right = set(left), set(right)
            only = [r for r in left if r not in in_right], [r for r in right if r not in in_left]
            found.append(f"values differ in {len(only[0])} and {len(only[1])} rows: {only[0][:2]} {only[1][:2]}")
    return found
