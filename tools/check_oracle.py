"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/check_oracle.py [--sf DIR] [key ...]
Compares row count, column names, column types (reported) and an
order-insensitive multiset of rows (floats rounded to 6 places).
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from hitweave.sources.tables import TABLES  # noqa: E402


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_types = dict(df.dtypes)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2), note="no oracle")
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_types = {c[0]: str(c[1]) for c in cur.description}
    d_rows = cur.fetchall()
    t2 = time.time()
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, note=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return res
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sa = sorted((tuple(norm(r[i]) for i in si) for r in s_rows), key=repr)
    da = sorted((tuple(norm(r[i]) for i in di) for r in d_rows), key=repr)
    res["types"] = {c: f"{s_types[c]}|{d_types[c]}" for c in order}
    bad_types = {c: v for c, v in res["types"].items()
                 if TYPE_MAP.get(s_types[c], s_types[c]) != d_types[c].split("(")[0]}
    if bad_types:
        res["type_mismatch"] = bad_types
    if sa == da:
        res.update(ok=True)
    else:
        sset, dset = set(sa), set(da)
        res.update(ok=False, note=f"only spark {len(sset - dset)}, only duck {len(dset - sset)}",
                   ex_spark=sorted(sset - dset, key=repr)[:2], ex_duck=sorted(dset - sset, key=repr)[:2])
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    from hitweave.plans.registry import ORACLE, QUERIES
    from hitweave.session import build_session
    spark = build_session(os.environ.get("HITWEAVE_MASTER", "local[8]"), 8)
    con = duck(a.sf)
    keys = a.keys or list(QUERIES)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, QUERIES[k], ORACLE.get(k), a.sf)
        except Exception as e:  # noqa: BLE001
            r = dict(name=k, ok=False, note=f"ERROR {type(e).__name__}: {str(e)[:600]}")
        bad += r.get("ok") is False
        types = r.pop("types", None)
        print(r, flush=True)
        if r.get("ok") is False and types:
            print("   types:", types, flush=True)
    print(f"FAILED {bad} of {len(keys)}")


if __name__ == "__main__":
    main()
