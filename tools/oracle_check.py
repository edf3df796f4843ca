"""Run registered queries in Spark and their DuckDB oracle SQL side by side.

usage: python tools/oracle_check.py [--sf DIR] [name-prefix ...]
Prints one line per query: OK / MISMATCH / ERROR / ROWS-ONLY, plus details.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, bool):
        return int(v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: json.dumps(t, default=str, ensure_ascii=False))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--tz", default=None, help="session time zone to run Spark with (robustness check)")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import duckdb
    from tickpulse.session import build_session
    from tickpulse.plans.registry import load_all

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    if a.tz:
        spark.conf.set("spark.sql.session.timeZone", a.tz)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    reg = load_all()
    names = [n for n in reg if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        e = reg[n]
        t0 = time.time()
        try:
            df = e.build(spark, a.sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:  # noqa: BLE001
            print(f"ERROR-SPARK {n}: {ex!r}"[:2000])
            traceback.print_exc(limit=3)
            bad += 1
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"ROWS-ONLY {n}: {len(rows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(e.sql)
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"ERROR-SQL {n}: {ex!r}"[:2000])
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"MISMATCH-COLS {n}: spark={sorted(cols)} sql={sorted(ocols)}")
            bad += 1
            continue
        a1, b1 = canon(cols, rows), canon(ocols, orows)
        if a1 == b1:
            print(f"OK {n}: {len(rows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            sa, sb = set(a1), set(b1)
            print(f"MISMATCH {n}: spark={len(rows)} sql={len(orows)}")
            print("   only spark:", [x for x in a1 if x not in sb][:3])
            print("   only sql  :", [x for x in b1 if x not in sa][:3])
    print(f"done: {len(names)} queries, {bad} not ok")
    spark.stop()


if __name__ == "__main__":
    main()
