"""Local stand-in for the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and an order-insensitive digest
of the values (doubles rounded to 6 places).
"""

from __future__ import annotations

import datetime
import math
import sys

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark, name, sf_dir, queries, oracles, con=None, verbose=True):
    con = con or duck(sf_dir)
    sdf = queries[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(oracles[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = canon(s_cols, s_rows)
    dc, dr = canon(d_cols, d_rows)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    if verbose and not ok:
        print(f"[{name}] MISMATCH cols_equal={sc == dc} rows spark={len(sr)} duck={len(dr)}")
        if sc != dc:
            print("  spark cols", sc)
            print("  duck  cols", dc)
        else:
            ds, ss = set(dr), set(sr)
            diff_s = [r for r in sr if r not in ds][:3]
            diff_d = [r for r in dr if r not in ss][:3]
            print("  spark only", diff_s)
            print("  duck only ", diff_d)
    return ok, len(sr)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import time

    import __spark_entry__ as E
    from boreframe.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.oracle_sql())
    spark = get_session(shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = []
    for n in names:
        t = time.time()
        try:
            ok, nrows = compare(spark, n, sf, qs, os_, con)
        except Exception as e:  # noqa: BLE001
            ok, nrows = False, -1
            print(f"[{n}] ERROR {type(e).__name__}: {str(e)[:400]}")
        print(f"{'OK ' if ok else 'BAD'} {n:32s} rows={nrows} {time.time() - t:.1f}s", flush=True)
        if not ok:
            bad.append(n)
    print("FAILED:", bad)
