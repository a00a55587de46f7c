"""Spark result against DuckDB result, row order aside.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([normal(r[i]) for i in order] for r in rows), key=repr)


DUCK_KIND = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, con, sql) -> str:
    """Empty text when equal, else what differs."""
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: DUCK_KIND.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if kinds != dict(df.dtypes):
        return f"types {[(c, k, kinds[c]) for c, k in df.dtypes if kinds[c] != k]}"
    duck_rows = rows_of(columns, result.fetchall())
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    if not spark_rows:
        return "no rows"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{sorted(columns)}\n   spark {a!r}\n   duck  {b!r}"[:3000]
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from kickpool.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = oracle_connection(sf)
    oracles = oracle_sql()
    bad = 0
    for name, build in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {error}"[:2500]
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} bad")
