"""Run registered queries on Spark and their SQL twins on DuckDB and compare the results.

python tools/compare.py [--sf DIR] [name-fragment ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    import datetime
    import decimal

    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~null" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def kind(t: str) -> str:
    t = t.upper()
    for k, names in {
        "int8": ("BIGINT", "LONG"), "int4": ("INTEGER", "INT"), "f8": ("DOUBLE",), "f4": ("FLOAT",),
        "str": ("VARCHAR", "STRING"), "ts": ("TIMESTAMP", "TIMESTAMP_NTZ"), "date": ("DATE",), "bool": ("BOOLEAN",),
    }.items():
        if t in names:
            return k
    return t


def main() -> int:
    import duckdb

    from lumenframe.catalog import ORACLES, QUERIES
    from lumenframe.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    bad = []
    for name in QUERIES:
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}")
            bad.append(name)
            continue
        took = time.time() - t0
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.2f}s  {str(got[:1])[:150]}")
            if not got:
                bad.append(name)
            continue
        try:
            cur = con.execute(ORACLES[name])
            names = [d[0] for d in cur.description]
            types = {d[0]: kind(str(d[1])) for d in cur.description}
            order = sorted(range(len(names)), key=lambda i: names[i])
            want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:700]}")
            bad.append(name)
            continue
        problems = []
        if sorted(names) != cols:
            problems.append(f"columns {cols} vs {sorted(names)}")
        else:
            mine = {c: kind(t) for c, t in df.dtypes}
            off = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
            if off:
                problems.append(f"types {off}")
        if len(got) != len(want):
            problems.append(f"rows {len(got)} vs {len(want)}")
        a, b = sorted(got), sorted(want)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values {cols} {str(diff)[:900]}")
        if not want:
            problems.append("no rows at all")
        print(("ok    " if not problems else "FAIL  ") + f"{name}: {len(got)} rows {took:.2f}s " + "; ".join(problems))
        if problems:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
