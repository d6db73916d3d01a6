"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive hash of the values.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def spark_kinds(df):
    from pyspark.sql import types as T

    def kind(t):
        if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return "int"
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            return "float"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.StringType):
            return "str"
        return t.simpleString()
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def duck_kinds(cur):
    def kind(t):
        t = str(t).upper()
        if t in ("BIGINT", "INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "NUMBER"):
            return "int"
        if t in ("DOUBLE", "FLOAT", "REAL") or t.startswith("DECIMAL"):
            return "float"
        if t in ("BOOLEAN", "BOOL"):
            return "bool"
        if t in ("VARCHAR", "STRING"):
            return "str"
        return t.lower()
    return {d[0]: kind(d[1]) for d in cur.description}


def duck_run(sf_dir, query):
    con = duckdb.connect()
    from partcast.plans.sqlkit import TABLES

    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(query)
    cols = [d[0] for d in cur.description]
    kinds = duck_kinds(cur)
    return cols, cur.fetchall(), kinds


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, ".")
    import __spark_entry__ as E

    qs, ors = E.queries(), E.oracle_sql()
    names = names or list(qs)
    results = {}
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            skinds = spark_kinds(df)
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:300])
            if verbose:
                print(f"{name:28s} SPARK_ERROR {str(e)[:300]}")
            continue
        st = time.time() - t0
        if name not in ors:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:28s} rows-only n={len(srows)} spark={st:.1f}s")
            continue
        try:
            dcols, drows, dkinds = duck_run(sf_dir, ors[name])
        except Exception as e:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", str(e)[:300])
            if verbose:
                print(f"{name:28s} DUCK_ERROR {str(e)[:300]}")
            continue
        sh, sl = digest(scols, srows)
        dh, dl = digest(dcols, drows)
        kinds_ok = skinds == dkinds
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and sh == dh and kinds_ok
        results[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name:28s} {'OK' if ok else 'MISMATCH'} spark_n={len(srows)} duck_n={len(drows)} "
                  f"spark={st:.1f}s")
            if not ok:
                if not kinds_ok:
                    print("   kinds spark:", {k: v for k, v in skinds.items() if dkinds.get(k) != v},
                          "\n   kinds duck: ", {k: v for k, v in dkinds.items() if skinds.get(k) != v})
                if sorted(scols) != sorted(dcols):
                    print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(dcols))
                else:
                    a, b = set(sl), set(dl)
                    print("   only spark:", sorted(a - b)[:3])
                    print("   only duck: ", sorted(b - a)[:3])
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from partcast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok; bad: {sorted(bad)}")
