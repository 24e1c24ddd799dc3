"""Compare registered queries with their SQL in DuckDB.

``python tests/compare.py /root/testdata/sf0.01 [query ...]`` prints one line
per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in at) for row in rows), key=repr)


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns, types and rows."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    wanted = found.fetchall()
    types = {n: t for n, t, *_ in db.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if same.get(kind) != types[name]:
            return f"type of {name}: {kind} vs {types[name]}"
    left, right = _rows(df.columns, df.collect()), _rows(names, wanted)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{sorted(names)}: {a} vs {b}"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from wayscore.session import build_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sql:
                result = differences(df, db, sql[name]) or "same"
            else:
                result = f"{len(df.collect())} rows, no SQL"
        except Exception as failure:
            result = f"{type(failure).__name__}: {str(failure)[:600]}"
        failed += not (result == "same" or result.endswith("no SQL"))
        print(f"{name:28s} {time.time() - start:6.2f} s  {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
