"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/oracle_check.py [name-prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def close(x, y):
    """Equal but for the last digit of a rounded mean: sums of doubles depend on
    the order in which engines add them."""
    return len(x) == len(y) and all(
        u == v or (isinstance(u, float) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-7)) for u, v in zip(x, y)
    )


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message, row count)"""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if len(a) != len(b):
        return False, f"{len(a)} rows != {len(b)}; e.g. {a[:2]} / {b[:2]}", len(a)
    noise = ""
    for x, y in zip(a, b):
        if x != y and close(x, y):
            noise = f"float noise: {x} / {y}"
        elif x != y:
            return False, f"{sorted(df.columns)}\n   spark {x}\n   sql   {y}", len(a)
    for x, y in zip(a[:50], b[:50]):
        for u, v in zip(x, y):
            if type(u) is not type(v) and u is not None and v is not None:
                return True, f"types {type(u).__name__}/{type(v).__name__} in {x}", len(a)
    return True, noise, len(a)


def main(argv):
    from tidemark.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", f"local[{os.environ.get('CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            ok, msg, n = compare(spark, con, fn, os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg, n = False, f"{type(e).__name__}: {str(e)[:500]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t:.2f}s {msg}", flush=True)
    print("failures:", bad, "of", len(qs), "with sql:", len(os_))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
