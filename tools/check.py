"""Run registered queries on Spark and their SQL on DuckDB, compare values.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotegrid.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
}


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("-0" if v == 0 and math.copysign(1, v) < 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    types = dict(df.dtypes)
    cols = df.columns
    got = canonical(cols, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in cur.description}
    want_cols = [d[0] for d in cur.description]
    want = canonical(want_cols, cur.fetchall())
    notes = []
    if sorted(cols) != sorted(want_cols):
        return len(got), f"columns differ: {sorted(cols)} vs {sorted(want_cols)}"
    for c, ty in types.items():
        if SAME.get(ty, ty).upper() != desc[c].upper() and not ty.startswith(("array", "map", "struct")):
            notes.append(f"type {c}: {ty} vs {desc[c]}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} vs {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        notes.append(f"{len(bad)} rows differ; columns {sorted(cols)}; first {bad[0][0]} vs {bad[0][1]}")
    return len(got), "; ".join(notes) or None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from quotegrid.workloads.catalog import ORACLE, QUERIES

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    failed = []
    for name in names:
        start = time.time()
        try:
            n, note = compare(spark, con, args.sf, QUERIES[name], ORACLE.get(name))
        except Exception as e:  # report and go on
            n, note = -1, f"{type(e).__name__}: {str(e)[:600]}"
        tag = "FAIL" if note else ("ok  " if name in ORACLE else "rows")
        if note:
            failed.append(name)
        print(f"{tag} {name} rows={n} {time.time() - start:.2f}s {note or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} green; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
