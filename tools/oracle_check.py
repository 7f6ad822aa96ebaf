"""Local stand-in for the driver's correctness gate: run each registered Spark query and its DuckDB oracle
on the same parquet tables and compare row count, column names and an order-insensitive value multiset."""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from longform.session import get_spark  # noqa: E402
from longform.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in records)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    from longform.catalog import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    names = args.names or list(qs)
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, args.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"rows-only {n}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sqls[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {n}: columns spark={sorted(scols)} duckdb={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            print(f"ok   {n}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {n}: spark {len(srows)} rows, duckdb {len(drows)} rows")
            only_s = list((a - b).elements())[:3]
            only_d = list((b - a).elements())[:3]
            print("   spark only:", only_s)
            print("   duckdb only:", only_d)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
