"""Compares a Spark result with DuckDB's, like the driver: by sorted columns, without order."""

import glob
import os

import duckdb


def _norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        return str({k: _norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = [dict(zip(names, row, strict=True)) for row in cur.fetchall()]
    ours = [r.asDict() for r in df.collect()]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(tuple(_norm(r[c]) for c in sorted(names)) for r in rows)
    assert key(ours) == key(theirs)
