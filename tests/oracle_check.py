"""Compare queries with their SQL on DuckDB: python tests/oracle_check.py <folder> [query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from waymark.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v}"
    if hasattr(v, "as_tuple"):
        v = float(v)
    return repr(v) if isinstance(v, float) else str(v)


def compare(spark, con, folder: str, name: str) -> str:
    started = time.time()
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(mine)} ({took:.1f}s)"
    cur = con.execute(sql)
    theirs_cols = [x[0] for x in cur.description]
    types = {x[0]: str(x[1]) for x in cur.description}
    if sorted(theirs_cols) != cols:
        return f"COLUMNS {cols} != {sorted(theirs_cols)}"
    order = [theirs_cols.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    mapped = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema
           if mapped.get(f.dataType.simpleString()) != types[f.name] and "STRING" not in types[f.name].upper()]
    note = f" types {odd}" if odd else ""
    if mine == theirs:
        return f"ok {len(mine)} ({took:.1f}s){note}"
    a, b = set(mine), set(theirs)
    return f"DIFF {len(mine)} vs {len(theirs)} rows{note}; cols {cols}\n   spark only {len(a - b)}: {sorted(a - b)[:3]}\n   duckdb only {len(b - a)}: {sorted(b - a)[:3]}"


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names or entry.queries():
        try:
            print(name, compare(spark, con, folder, name), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:500].replace("\n", " "), flush=True)


if __name__ == "__main__":
    main()
