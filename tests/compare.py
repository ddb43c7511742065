"""Run a registered query in Spark and its statement in DuckDB and compare the values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def check_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [[_norm(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols), key=lambda r: tuple((v is None, str(type(v)), v) if v is not None
                                                  else (True, "", 0) for v in r)) if names else []


def difference(spark_df, con, sql: str) -> str | None:
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    kinds = []
    for n in sorted(got.column_names):
        a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
        a, b = a.replace("large_", ""), b.replace("large_", "")
        if a != b and b != "null":
            kinds.append(f"{n}: {a} != {b}")
    if kinds:
        return "types " + "; ".join(kinds)
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            off = [f"{n}: {p!r} != {q!r}" for n, p, q in zip(sorted(got.column_names), x, y) if p != q]
            return f"values differ: {off} in {x}"
    return None
