"""Run registered queries in Spark and DuckDB and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP",
                 "date": "DATE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None when both engines agree on schema and rows, else a short description."""
    res = con.execute(sql)
    duck_cols = [d[0] for d in res.description]
    duck_types = {d[0]: str(d[1]) for d in res.description}
    duck_rows = res.fetchall()
    if sorted(df.columns) != sorted(duck_cols):
        return f"columns {sorted(df.columns)} vs {sorted(duck_cols)}"
    kinds = {n: SPARK_TO_DUCK.get(k, k) for n, k in df.dtypes}
    bad = {n: (k, duck_types[n]) for n, k in kinds.items() if k != duck_types[n]}
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(duck_cols, duck_rows)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}; types {bad}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ in {sorted(duck_cols)}, first {wrong[0]}"
    if bad:
        return f"types {bad}"
    return None if a else "no rows"


def main(sf_dir: str, *names: str) -> int:
    from pvgrid.plans import queries as q
    from pvgrid.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name, build in q.QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in q.SQL:
                diff = difference(df, con, q.SQL[name])
                note = f"{df.count()} rows" if diff is None else f"DIFF {diff}"
            else:
                diff, note = None, f"{df.count()} rows, no SQL"
        except Exception as exc:  # report and go on with the next query
            diff = note = "ERROR " + str(exc).split("\n\nJVM")[0][:700]
        failures += diff is not None
        print(f"{name}: {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
