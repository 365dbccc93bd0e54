"""Run registered queries against their SQL in DuckDB.

``python tests/oracle.py [sf_dir] [prefix ...]`` prints one line per query.
"""
from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, sf_dir, run, sql):
    """'' when both sides agree, else what differs."""
    df = run(spark, sf_dir)
    a_names, a = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = table([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {sorted(set(a_names) ^ set(b_names))}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(n, p, q) for n, p, q in zip(a_names, x, y) if p != q]
        return f"{len(bad)} rows differ, first {x[:3]}: {diff[:4]}", len(a)
    return "", len(a)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tapeworks.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sqls, failed = build_session("8"), connect(sf), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg, n = compare(spark, con, sf, run, sqls[name])
            else:
                msg, n = "", len(run(spark, sf).collect())
        except Exception as e:  # report and go on with the next query
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name:36s} rows={n:<7d} {time.time() - t0:5.1f}s "
              f"{'' if name in sqls else '(no sql) '}{msg}", flush=True)
    print("failed", failed)
