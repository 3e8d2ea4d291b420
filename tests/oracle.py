"""Runs queries beside their DuckDB SQL: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """An empty string if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = duck(sf_dir).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        odd = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only here {odd[0]}; only there {odd[1]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tests.conftest import make_session

    spark = make_session()
    found, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(found):
        began = time.time()
        if name in sql:
            said = compare(spark, sys.argv[1], found[name], sql[name]) or "equal"
        else:
            said = f"{found[name](spark, sys.argv[1]).count()} rows, no SQL"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
