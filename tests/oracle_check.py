"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py FOLDER [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def normal(columns, rows):
    """Rows with columns in name order, sorted by their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, query, sql, folder):
    """(spark rows, sql rows, first difference or None)."""
    df = query(spark, folder)
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = normal(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(left), len(right), f"columns {sorted(df.columns)} / {sorted(names)}"
    if left == right:
        return len(left), len(right), None
    only = [r for r in left if r not in right][:2] if len(left) < 20000 else left[:1]
    other = [r for r in right if r not in left][:2] if len(right) < 20000 else right[:1]
    return len(left), len(right), f"only spark {only} only sql {other}"


def main(folder: str, names: list[str]) -> int:
    from storelens.oracle import ORACLE
    from storelens.queries import QUERIES
    from storelens.session import local_session

    spark, con, bad = local_session(), connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                n, m, diff = compare(spark, con, QUERIES[name], ORACLE[name], folder)
            else:
                df = QUERIES[name](spark, folder)
                rows = df.collect()
                n, m, diff = len(rows), "-", None
                print(rows[:2])
        except Exception as exc:
            n, m, diff = "?", "?", f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name:24} {n} / {m}  {time.time() - start:.2f}s {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
