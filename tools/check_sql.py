"""Run registered queries and their SQL twins side by side and report differences.

    python tools/check_sql.py [--dir DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsmart.plans import load_all  # noqa: E402
from newsmart.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry = load_all()
    names = [n for n in registry if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.dir}/{t}.parquet'")
    bad = 0
    for n in names:
        item = registry[n]
        t0 = time.time()
        try:
            df = item(spark, args.dir)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: spark: {str(exc)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if item.sql is None:
            print(f"rows {n}: {len(rows)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(item.sql)
            dcols = [d[0] for d in cur.description]
            order = sorted(range(len(dcols)), key=lambda i: dcols[i])
            drows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: sql: {str(exc)[:1200]}", flush=True)
            continue
        t2 = time.time()
        key = lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
        a, b = sorted(rows, key=key), sorted(drows, key=key)
        if sorted(dcols) != cols:
            bad += 1
            print(f"DIFF {n}: columns {cols} vs {sorted(dcols)}", flush=True)
        elif a != b:
            bad += 1
            print(f"DIFF {n}: {len(a)} vs {len(b)} rows  cols={cols}", flush=True)
            sa, sb = set(map(repr, a)), set(map(repr, b))
            for x in sorted(sa - sb)[:3]:
                print("   spark", x[:400])
            for x in sorted(sb - sa)[:3]:
                print("   sql  ", x[:400])
        else:
            print(f"ok   {n}: {len(a)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
    print("bad", bad, "of", len(names))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
