"""Run registered queries next to their SQL twins: python tests/check_queries.py [sf] [name ...]"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from corpusmill.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), "rows only"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), f"spark {str(a)[:700]}\n    sql   {str(b)[:700]}"
    return len(got), "ok" if got else "ok but empty"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session(master="local[8]", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            n, verdict = compare(spark, con, sf_dir, name)
        except Exception as e:  # show every failure, then go on
            n, verdict = -1, f"{type(e).__name__} {str(e)[:900]}"
        bad += not verdict.startswith(("ok", "rows only"))
        if len(sys.argv) > 2 or verdict != "ok" or time.time() - start > 3:
            print(f"{name} [{n}] {time.time() - start:.1f}s {verdict}", flush=True)
    print(f"{bad} bad of {len(sys.argv[2:]) or len(entry.queries())}")
