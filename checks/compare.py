"""Run registered queries against their oracles: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

from checks.catalog import QUERIES, SQL
from turnout.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return int(f) if f == int(f) else round(f, 9)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(x[i]) for i in order) for x in data), key=repr)


def main(argv):
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in SQL:
                print(f"rows  {name:24s} {len(got):8d}           spark {t1 - t0:6.1f}s", flush=True)
                continue
            res = con.execute(SQL[name])
            cols = [c[0] for c in res.description]
            want = rows(cols, res.fetchall())
            t2 = time.time()
            same = sorted(cols) == sorted(df.columns) and got == want
            print(f"{'ok   ' if same else 'DIFF '} {name:24s} {len(got):8d} {len(want):8d}  spark {t1 - t0:6.1f}s  sql {t2 - t1:6.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("   columns", sorted(df.columns), sorted(cols))
                g, w = set(got), set(want)
                print("   only spark", [x for x in got if x not in w][:3], len(g - w))
                print("   only sql  ", [x for x in want if x not in g][:3], len(w - g), flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(e)[:600]}", flush=True)
            if "-v" in os.environ.get("COMPARE", ""):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
