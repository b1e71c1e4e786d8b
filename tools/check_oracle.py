"""Compare every registered query with its SQL form in DuckDB: rows, column names, kinds and values.

Usage: python tools/check_oracle.py [folder] [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradewise.plans import all_queries  # noqa: E402
from gradewise.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if not hasattr(value, "hour") else value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, db, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    frame = all_queries.run(name, spark, folder)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    sql = all_queries.SQL.get(name)
    if sql is None:
        return True, f"rows only: {len(got)} ({took:.1f}s)"
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left == right:
        return True, f"{len(got)} rows ({took:.1f}s)"
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return False, f"{len(left)} against {len(right)} rows\n   spark {only_left}\n   sql   {only_right}"


def main(argv: list[str]) -> int:
    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:] or list(all_queries.QUERIES)
    spark, db, failed = build_session("check"), connect(folder), []
    for name in wanted:
        try:
            good, note = compare(spark, db, name, folder)
        except Exception as error:  # report and go on
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(("ok   " if good else "FAIL ") + name + ": " + note, flush=True)
        if not good:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
