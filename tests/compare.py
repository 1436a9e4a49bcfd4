"""Run registered queries on Spark and their SQL on DuckDB, and compare.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """One form for values both engines spell differently."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None when both agree, else a short description of the difference."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference:\n   spark {a}\n  duckdb {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from dataquay.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session("compare", cpus=8)
    con = duckdb_connection(folder)
    oracles, failed = oracle_sql(), 0
    for name, run in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
            bad = problem is not None and name in oracles
        except Exception as error:  # report and go on with the next query
            problem, bad = f"{type(error).__name__}: {str(error)[:1500]}", True
        failed += bad
        print(f"\n{'FAIL' if bad else 'ok':5}{name:28}{time.time() - start:6.1f}s  {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
