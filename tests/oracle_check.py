"""Compare every registered query with its DuckDB oracle (like the driver).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH with the reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wrenchflow.session import get_session  # noqa: E402
from wrenchflow.sources.binding import DRIVER_TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def _kind(dtype) -> str:
    s = str(dtype)
    if s.startswith("int") or s.startswith("Int"):
        return "int" + ("64" if "64" in s else "32" if "32" in s else s)
    if s.startswith("float"):
        return "float"
    if s == "bool" or s == "boolean":
        return "bool"
    return "object"


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "smallint": "SMALLINT"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name}: SPARK-ONLY rows={len(sp)} ({t1 - t0:.1f}s)"
    rel = con.sql(sql)
    declared = dict(zip(rel.columns, [str(t) for t in rel.types]))
    du = rel.df()
    problems = []
    type_diffs = [(f.name, f.dataType.simpleString(), declared.get(f.name)) for f in sdf.schema.fields
                  if SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) != declared.get(f.name)]
    if type_diffs:
        problems.append(f"declared types {type_diffs}")
    if sorted(sp.columns) != sorted(du.columns):
        problems.append(f"columns spark={sorted(sp.columns)} duck={sorted(du.columns)}")
    else:
        kinds = [(c, _kind(sp[c].dtype), _kind(du[c].dtype)) for c in sorted(sp.columns)]
        def nullable_int(c, a, b):
            pair = {a[:3], b[:3]}
            return pair in ({"int", "flo"}, {"obj", "boo"}) and (sp[c].isna().any() or du[c].isna().any())
        bad = [k for k in kinds if k[1] != k[2] and not (len(sp) == 0 or len(du) == 0)
               and not nullable_int(*k)]
        if bad:
            problems.append(f"dtypes {bad}")
        if len(sp) != len(du):
            problems.append(f"rows spark={len(sp)} duck={len(du)}")
        else:
            cs, rs = _rows(sp)
            _, rd = _rows(du)
            if rs != rd:
                diff = [(a, b) for a, b in zip(rs, rd) if a != b][:2]
                problems.append(f"values differ cols={cs} e.g. {diff}")
    status = "OK" if not problems else "MISMATCH " + "; ".join(problems)
    return f"{name}: {status} rows={len(sp)} ({t1 - t0:.1f}s)"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and continue
            line = f"{name}: ERROR {type(exc).__name__}: {str(exc)[:400]}"
        if "OK" not in line.split(":")[1][:4] and "SPARK-ONLY" not in line:
            bad += 1
        print(line, flush=True)
    print(f"TOTAL {len(qs)} queries, {len(sqls)} with oracle, {bad} not OK")


if __name__ == "__main__":
    main(sys.argv)
