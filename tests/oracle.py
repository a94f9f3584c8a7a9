"""Run registered queries next to their SQL in DuckDB and compare values."""
from __future__ import annotations

import glob
import os

import duckdb

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(root: str):
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (v is None, "f", v) for v in row)


def compare(spark, con, name: str, run, sql: str, root: str) -> list[str]:
    """Differences as text; an empty list means equal."""
    df = run(spark, root)
    cols = sorted(df.columns)
    left = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    if sorted(types) != cols:
        return [f"columns {cols} / {sorted(types)}"]
    order = [d[0] for d in res.description]
    at = [order.index(c) for c in cols]
    right = [tuple(r[i] for i in at) for r in res.fetchall()]
    out = []
    for f in df.schema:
        want = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if types[f.name] not in (want, '"NULL"'):
            out.append(f"type of {f.name}: {f.dataType.simpleString()} / {types[f.name]}")
    if len(left) != len(right):
        out.append(f"rows {len(left)} / {len(right)}")
    a, b = sorted(left, key=key), sorted(right, key=key)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        out.append(f"{len(diff)} rows differ, e.g. {diff[0]}")
    return out
