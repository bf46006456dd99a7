"""Compare registered queries with their SQL twins: ``python tests/oracle.py FOLDER [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from foliarc.plans.registry import TABLES  # noqa: E402
from foliarc.session import build_session  # noqa: E402


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark, con, folder, name):
    """None when equal, else a message."""
    df = entry.queries()[name](spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got_cols else "no columns"
    cursor = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"
    return None if got else "empty"


def main():
    folder, names = sys.argv[1], sys.argv[2:]
    known = entry.queries()
    picked = [n for n in known if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    spark, con = build_session(), connect(folder)
    bad = 0
    for name in picked:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as exc:  # noqa: BLE001
            text = str(exc)
            problem = f"ERROR {type(exc).__name__}: {text[:700]}"
            if "-v" in os.environ.get("ORACLE", ""):
                traceback.print_exc()
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{mark} {name} {time.time() - start:.1f}s{kind} {problem or ''}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} fine")


if __name__ == "__main__":
    main()
