"""Run registered queries beside their checking SQL and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    cols = df.columns
    got = [tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in df.collect()]
    if sql is None:
        return f"rows={len(got)} (no SQL)", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    if sorted(cols) != sorted(names):
        return f"columns differ: {sorted(cols)} vs {sorted(names)}", False
    bad_types = [c for c, d in ((c, dict(df.dtypes)[c]) for c in cols) if d in ("void",)]
    a, b = Counter(got), Counter(want)
    if a != b:
        return f"rows {len(got)} vs {len(want)}; only here {list((a - b).items())[:4]}; only there {list((b - a).items())[:4]}", False
    ty = {d[0]: str(d[1]) for d in cur.description}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (d, ty[c]) for c, d in df.dtypes if pairs.get(d, ty[c]) != ty[c] and got}
    return f"rows={len(got)}" + (f" TYPES {odd or bad_types}" if odd or bad_types else ""), not (odd or bad_types)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallygrid.session import build_session
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", partitions=8, driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, os_ = entry.queries(), entry.oracle_sql()
    fails = []
    for n, fn in qs.items():
        if only and not any(n.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            msg, ok = compare(spark, con, n, fn, os_.get(n), sf)
        except Exception as e:
            msg, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        if not ok:
            fails.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", fails)
