"""Run a registered query on Spark and its oracle on DuckDB, and compare the results.

Mirrors the driver's gate: equal row count, equal column names, equal multiset of rows
(columns sorted by name, floats compared after rounding).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

import os as _os
EXACT = bool(_os.environ.get("EXACT_FLOATS"))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT"}


def type_mismatches(sdf, con, sql) -> list[str]:
    """Columns whose Spark type does not correspond to the oracle's DuckDB type."""
    duck_types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    bad = []
    for c, t in sdf.dtypes:
        want = SPARK_TO_DUCK.get(t, t.upper())
        if t.startswith("array<"):
            want = SPARK_TO_DUCK.get(t[6:-1], t[6:-1].upper()) + "[]"
        if duck_types.get(c) != want:
            bad.append(f"{c}: {t} vs {duck_types.get(c)}")
    return bad


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (round(v, 5) + 0.0) if not EXACT else v + 0.0
    if isinstance(v, decimal.Decimal):
        return (round(float(v), 5) + 0.0) if not EXACT else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v.asDict(recursive=True).values())
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def compare(name: str, spark, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2),
           "nested_loop": "NestedLoopJoin" in plan or "CartesianProduct" in plan}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    out["type_mismatches"] = type_mismatches(sdf, con, sql)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = [tuple(r) for r in rel.fetchall()]
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"columns differ: spark={s_cols} oracle={d_cols}"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_idx = [d_cols.index(s_cols[i]) for i in order]
    s_norm = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[i]) for i in d_idx) for r in d_rows), key=_key)
    if len(s_norm) != len(d_norm):
        out["status"] = "row count differs"
        return out
    bad = [(a, b) for a, b in zip(s_norm, d_norm) if a != b]
    if bad:
        out["status"] = f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
        return out
    out["status"] = "match"
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from ashgrid.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    import os
    if os.environ.get("SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
    from __spark_entry__ import queries
    con = duck(sf)
    bad = 0
    for n in (names or sorted(queries())):
        try:
            r = compare(n, spark, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:40s} {r.get('spark_rows')}/{r.get('oracle_rows')} "
              f"{r.get('spark_sec')}s {'' if ok else r['status']}", flush=True)
    print("failures:", bad)
