"""Compare a registered query with its SQL form in DuckDB on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "f", round(x, 3)) for x in r])


_KINDS = {
    "bigint": "int64", "int": "int32", "double": "double", "string": "string",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "boolean": "bool",
}
_DUCK = {
    "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "bool",
}


def compare(spark, con, q, folder: str, tolerance: float = 2e-6) -> tuple[str, int]:
    """'' when schema, row count and values agree, else the first difference."""
    df = q.run(spark, folder)
    s_types = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(q.sql)
    d_types = {n: _DUCK.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    d_cols, d_rows = _rows(rel.columns, rel.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}", len(s_rows)
    if s_types != d_types:
        return f"types {[(k, s_types[k], d_types[k]) for k in s_cols if s_types[k] != d_types[k]]}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}", len(s_rows)
    exact = True
    for a, b in zip(s_rows, d_rows):
        for c, x, y in zip(s_cols, a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1.0, abs(x)):
                exact = False
                continue
            return f"{c}: {x!r} != {y!r} in {a} / {b}"[:600], len(s_rows)
    return ("" if exact else "ROUNDING"), len(s_rows)
