"""Run registered queries against their SQL twins in DuckDB.

    python tools/check.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from framewright.plans import registry  # noqa: E402
from framewright.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for rec in df.itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or pd.isna(v):
                row.append(None)
            elif isinstance(v, float) and abs(v) < 1e15 and v == int(v):
                row.append(int(v))
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        rows.append(tuple(row))
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, sql = registry.all_queries(), registry.all_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"rows  {name:34s} {len(got):8d} rows  spark {t1 - t0:6.2f}s")
                continue
            want = con.sql(sql[name]).df()
            t2 = time.time()
            a, b = normal(got), normal(want)
            ok = sorted(got.columns) == sorted(want.columns) and a == b
            note = "" if kinds(got) == kinds(want) else f" dtypes {[(c, x, kinds(want).get(c)) for c, x in kinds(got).items() if x != kinds(want).get(c)]}"
            print(f"{'ok   ' if ok else 'DIFF '} {name:34s} {len(got):8d} rows  spark {t1 - t0:6.2f}s  duckdb {t2 - t1:6.2f}s{note}",
                  flush=True)
            if not ok:
                bad += 1
                print("   columns", sorted(got.columns), sorted(want.columns), len(a), len(b))
                sa, sb = set(a), set(b)
                print("   spark only ", sorted(sa - sb, key=str)[:3], len(sa - sb))
                print("   duckdb only", sorted(sb - sa, key=str)[:3], len(sb - sa))
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
