"""Run registered queries on Spark and their oracle SQL on DuckDB; compare results.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: rows, column names, exact value match, match at 1e-9.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pulse.session import get_spark  # noqa: E402
from pulse import registry  # noqa: E402
from pulse.sources.tables import DRIVER_TABLES  # noqa: E402


def norm(v, tol):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not hasattr(v, "tolist") or type(v).__module__ == "numpy":
        try:
            v = v.item()
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"  # NaN and NULL are different values for the driver's hash
        return round(v, tol) if tol else v
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def rows_of(pdf, tol):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(None if (x is None or (isinstance(x, float) and math.isnan(x) and False)) else x, tol)
                         for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[2:] if not a.startswith("--")]
    oracle_only = "--oracle-only" in sys.argv
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if oracle_only and name not in sqls:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            spd = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:32s} rows={len(spd):6d} (no oracle) {ts:.2f}s")
            continue
        try:
            dpd = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(spd.columns) == sorted(dpd.columns)
        ok_rows = len(spd) == len(dpd)
        exact = same_cols and ok_rows and rows_of(spd, 0) == rows_of(dpd, 0)
        approx = same_cols and ok_rows and rows_of(spd, 9) == rows_of(dpd, 9)
        flag = "OK " if exact else ("~OK" if approx else "BAD")
        if not exact:
            bad += 1
        print(f"{name:32s} {flag} rows={len(spd)}/{len(dpd)} cols={'same' if same_cols else (sorted(spd.columns), sorted(dpd.columns))} {ts:.2f}s")
        if not approx and same_cols and ok_rows:
            a, b = rows_of(spd, 9), rows_of(dpd, 9)
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diffs:
                print("   spark :", x)
                print("   duckdb:", y)
        if same_cols:
            st = [str(t) for t in sdf.schema]
            dt = list(zip(dpd.columns, [str(x) for x in dpd.dtypes]))
    print("not exact:", bad)


if __name__ == "__main__":
    main()
