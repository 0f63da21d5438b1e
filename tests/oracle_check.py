"""Run registered queries next to their SQL and compare as multisets of rows.

Usage: python -m tests.oracle_check [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    names, mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    onames, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != onames:
        return False, f"columns {names} vs {onames}", sum(mine.values())
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        return False, (f"{sum(mine.values())} vs {sum(theirs.values())} rows, {sum(a.values())} differ; cols {names}\n"
                       f"      spark {list(a)[:2]}\n      sql   {list(b)[:2]}"), sum(mine.values())
    return True, "", sum(mine.values())


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    qs, os_ = queries(), oracle_sql()
    chosen = [k for k in qs if not argv or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    bad = 0
    for k in chosen:
        t0 = time.time()
        try:
            if k in os_:
                ok, why, n = compare(spark, con, qs[k], os_[k], sf_dir)
            else:
                n = len(qs[k](spark, sf_dir).collect())
                ok, why = n > 0, "rows only"
        except Exception as e:                                    # noqa: BLE001
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {k:32s} {n:7d} rows {time.time() - t0:6.1f}s {why}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
