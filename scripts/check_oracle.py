"""Run registered queries on Spark and their SQL on DuckDB; compare.

usage: python scripts/check_oracle.py [sf_dir] [name-prefix ...]
Prints one line per query: OK, ROWS (no oracle), or a mismatch summary.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vellum.session import get_session  # noqa: E402
from vellum.sources.tables import TABLES  # noqa: E402
from vellum.suite import load_all  # noqa: E402


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


def spark_type(dt) -> str:
    from pyspark.sql import types as T
    m = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
         T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP",
         T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.ShortType: "SMALLINT", T.ByteType: "TINYINT"}
    for k, v in m.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return spark_type(dt.elementType) + "[]"
    if isinstance(dt, T.MapType):
        return f"MAP({spark_type(dt.keyType)}, {spark_type(dt.valueType)})"
    return dt.simpleString().upper()


def rowkey(r):
    return tuple((type(x).__name__, repr(x)) for x in r)


def close(a, b):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if not (x == y or abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))):
                return False
        elif isinstance(x, tuple) and isinstance(y, tuple):
            if not close(x, y):
                return False
        elif x != y:
            return False
    return True


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = get_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, q in sorted(reg.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sdf = q.run(spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:
            bad += 1
            print(f"{name:40s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"{name:40s} ROWS {len(srows)} ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:
            bad += 1
            print(f"{name:40s} DUCK-ERROR {str(e)[:300]}")
            continue
        if os.environ.get("CHECK_TYPES"):
            st = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
            dtypes = {d[0]: str(d[1]) for d in res.description}
            diff = {c: (st[c], dtypes.get(c)) for c in st if st[c] != dtypes.get(c)}
            if diff:
                print(f"{name:40s} TYPES {diff}")
        if sorted(scols) != sorted(dcols):
            bad += 1
            print(f"{name:40s} COLS spark={scols} duck={dcols}")
            continue
        si = sorted(range(len(scols)), key=lambda i: scols[i])
        di = sorted(range(len(dcols)), key=lambda i: dcols[i])
        sr = sorted((tuple(r[i] for i in si) for r in srows), key=rowkey)
        dr = sorted((tuple(r[i] for i in di) for r in drows), key=rowkey)
        if len(sr) != len(dr):
            bad += 1
            print(f"{name:40s} COUNT spark={len(sr)} duck={len(dr)}")
            continue
        if sr == dr:
            print(f"{name:40s} OK {len(sr)} rows ({ts:.1f}s)")
            continue
        bad += 1
        ok_close = all(close(a, b) for a, b in zip(sr, dr))
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
        cols = [scols[i] for i in si]
        print(f"{name:40s} {'CLOSE' if ok_close else 'VALUES'} {len(sr)} rows cols={cols}")
        for a, b in diff:
            print("   spark:", a)
            print("   duck: ", b)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
