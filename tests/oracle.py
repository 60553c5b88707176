"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """Rows of the query, and a description of the first difference or None."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return got, None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return got, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return got, f"{len(got)} rows vs {len(want)}; first {got[:1]} vs {want[:1]}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            return got, f"{g} vs {w} ({sorted(columns)})"
    return got, None


def main() -> int:
    """``python tests/oracle.py [sf_dir] [name prefix …]``"""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from samplemill.plans.session import local_session
    from samplemill.queries import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session("oracle", "8")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got, problem = compare(spark, con, sf_dir, fn, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            if prefixes:
                traceback.print_exc(limit=3)
            got, problem = [], f"{type(error).__name__}: {str(error)[:600]}"
        state = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        bad += bool(problem)
        print(f"{state:5}{name:36}{len(got):8} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
