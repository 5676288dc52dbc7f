"""Compares registered queries with their SQL, cell by cell."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """``None`` when equal, else the first difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first:\n  spark {bad[0][0]}\n  sql   {bad[0][1]}" if bad else None


def check(spark, sf_dir, queries, sql, names) -> int:
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                found = compare(spark, con, sf_dir, queries[name], sql[name])
                note = "equal" if found is None else f"DIFFERENT: {found}"
            else:
                note = f"rows only: {len(queries[name](spark, sf_dir).collect())}"
                found = None
        except Exception as e:  # noqa: BLE001
            found, note = e, f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += found is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {note}", flush=True)
    return failed
