"""Runs registered queries against their DuckDB oracles and compares whole results.

``python tests/compare.py [sf_dir] [name prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "is_nan") or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if isinstance(value, list):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} vs {len(want)} rows; spark only {only_got}; oracle only {only_want}"
    return True, f"{len(got)} rows, {took:.1f}s"


def main() -> int:
    from feedledger.session import local_session
    from feedledger.workload import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con, failed = local_session(8, 8), connect(sf_dir), 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note[:900]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
