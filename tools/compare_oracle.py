"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and values (order-insensitive)."""
from __future__ import annotations

import json
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, "/root/repo")
from foldspark.plans.catalog import load_all  # noqa: E402
from foldspark.session import get_spark  # noqa: E402
from foldspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main(sf_dir: str, names: list[str]):
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    reg = load_all()
    res = {}
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            s = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, res[name], flush=True)
            continue
        ts = time.time() - t0
        if q.oracle is None:
            res[name] = f"rows-only n={len(s)} t={ts:.1f}s"
            print(name, res[name], flush=True)
            continue
        try:
            d = con.sql(q.oracle).df()
        except Exception as e:  # noqa: BLE001
            res[name] = f"ORACLE ERROR {str(e)[:400]}"
            print(name, res[name], flush=True)
            continue
        msg = []
        if len(s) != len(d):
            msg.append(f"rows {len(s)} vs {len(d)}")
        if sorted(s.columns) != sorted(d.columns):
            msg.append(f"cols {sorted(set(s.columns) ^ set(d.columns))}")
        else:
            a, b = rows(s), rows(d)
            if a != b:
                bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
                msg.append(f"values differ e.g. {bad}"[:600])
        res[name] = ("OK" if not msg else "FAIL " + "; ".join(msg)) + f" n={len(s)} t={ts:.1f}s"
        print(name, res[name], flush=True)
    print(json.dumps({k: v.split()[0] for k, v in res.items()}))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
