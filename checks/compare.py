"""Compare registered queries with their SQL: ``python -m checks.compare <folder> [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import all_sql
from checks.queries import all_queries


def database(folder: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with one view per parquet file."""
    found = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        found.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return found


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; numbers and dates in one spelling each."""

    def cell(value) -> str:
        if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
            return "null"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value)).lower()
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(float(value))
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(value)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(value) for value in row) for row in frame[columns].itertuples(index=False, name=None))


def difference(spark: SparkSession, base: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None if query and SQL agree, else what differs first."""
    mine = all_queries()[name](spark, folder).toPandas()
    theirs = base.execute(all_sql()[name]).fetchdf()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for left, right in zip(canonical(mine), canonical(theirs), strict=True):
        if left != right:
            return f"{left} != {right}"
    return None


def main(folder: str, names: list[str]) -> int:
    from carequeue.session import build_session

    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    base, failed = database(folder), 0
    for name in names or list(all_queries()):
        started = time.time()
        if name not in all_sql():
            rows = all_queries()[name](spark, folder).count()
            print(f"rows  {name} {rows} {time.time() - started:.1f}s", flush=True)
            continue
        try:
            found = difference(spark, base, folder, name)
        except Exception as error:  # noqa: BLE001 - report every query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok   ' if found is None else 'DIFF '} {name} {time.time() - started:.1f}s {found or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
