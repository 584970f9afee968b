"""Compare a registered query with its SQL on DuckDB: row counts, column names and values in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'") if glob.glob(p) else None
    got = query(spark, sf_dir)
    want = con.sql(sql)
    names, theirs = sorted(got.columns), sorted(want.columns)
    if names != theirs:
        return f"columns {names} and {theirs}"
    if nested := [f"{n} {t}" for n, t in got.dtypes if t.startswith(("array", "map", "struct"))]:
        return f"nested columns {nested}"
    at = [want.columns.index(n) for n in names]
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows of {names}; only here {only_a}; only in SQL {only_b}"
