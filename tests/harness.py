"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

from veilframe.plans import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    """A comparable form of a value: numbers by value, containers by content."""
    if value is None:
        return ("0",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return ("n", repr(value + 0.0))
    if isinstance(value, int):
        return ("n", repr(float(value)))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("t", str(value))
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return ("l", tuple(cell(v) for v in value))
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return ("d", tuple((k, cell(v)) for k, v in sorted(value.items())))
    return ("s", str(value))


def spark_rows(df):
    columns = sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    return columns, sorted(tuple(cell(r[i]) for i in order) for r in df.collect())


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when the results are equal, else a short description."""
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name not in SQL:
        return None if rows else "no rows"
    sql_columns, expected = sql_rows(con, SQL[name])
    if columns != sql_columns:
        return f"columns {columns} != {sql_columns}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0][0]} != {wrong[0][1]}"
    return None


def main(argv: list[str]) -> None:
    from veilframe.session import build_session

    sf_dir = argv[0]
    names = argv[1:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in SQL else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
