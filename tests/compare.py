"""Spark result against its SQL twin: same columns, same multiset of rows.

Run as a script for a whole scale factor: ``python tests/compare.py DIR [name ...]``.
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time
from collections import Counter


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(cell(i) for i in x)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def expected(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def actual(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def main(sf_dir, names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            columns, got = actual(fn(spark, sf_dir))
        except Exception as exc:
            bad.append(name)
            print(f"FAIL  {name}: {str(exc)[:700]}")
            continue
        took = time.time() - started
        if name not in oracles:
            print(f"rows  {name}: {sum(got.values())} rows {took:.1f}s")
            continue
        try:
            started = time.time()
            want_columns, want = expected(con, oracles[name])
            sql_took = time.time() - started
        except Exception as exc:
            bad.append(name)
            print(f"SQL   {name}: {str(exc)[:500]}")
            continue
        if columns != want_columns or got != want:
            bad.append(name)
            print(f"DIFF  {name}: {columns} vs {want_columns}; {sum(got.values())} vs {sum(want.values())} rows")
            print("   only spark:", list((got - want).items())[:3])
            print("   only sql:  ", list((want - got).items())[:3])
        else:
            print(f"ok    {name}: {sum(got.values())} rows {took:.1f}s (sql {sql_took:.1f}s)")
        sys.stdout.flush()
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
