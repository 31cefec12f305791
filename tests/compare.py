"""Run registered queries in Spark and DuckDB and compare rows, ignoring their order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

SMALL = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _sorted(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in rows)


def difference(spark, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str | None:
    """What differs, or None. Without SQL only the Spark side is run."""
    result = contract.queries()[name](spark, folder)
    mine = _sorted(result.columns, [tuple(row) for row in result.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} and {sorted(columns)}"
    theirs = _sorted(columns, cursor.fetchall())
    if mine != theirs:
        pairs = [pair for pair in zip(mine, theirs) if pair[0] != pair[1]]
        return f"{len(mine)} and {len(theirs)} rows, first difference {pairs[:1]}"
    return None


if __name__ == "__main__":
    from footfall.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or contract.queries():
        started = time.time()
        try:
            found = difference(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{time.time() - started:6.2f} s  {name}: {found or 'ok'}", flush=True)
