"""Order-free comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = normal([d[0] for d in cur.description], cur.fetchall())
    types = {d[0]: str(d[1]) for d in cur.description}
    problems = []
    if left[0] != right[0]:
        return [f"columns {left[0]} vs {right[0]}"]
    wide = [c for c, t in types.items() if "HUGEINT" in t or t.startswith("DECIMAL")]
    if wide:
        problems.append(f"wide oracle types: {wide}")
    spark_wide = [f.name for f in df.schema.fields if "decimal" in f.dataType.simpleString()]
    if spark_wide:
        problems.append(f"decimal spark columns: {spark_wide}")
    if len(left[1]) != len(right[1]):
        problems.append(f"rows {len(left[1])} vs {len(right[1])}")
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        problems.append(f"columns={left[0]}\n  only spark {sorted(a - b)[:3]}\n  only sql   {sorted(b - a)[:3]} ({len(a-b)}/{len(b-a)})")
    if not left[1]:
        problems.append("empty result")
    return problems
