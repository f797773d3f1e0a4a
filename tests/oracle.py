"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _kind(type_name: str) -> str:
    names = {
        "string": "string",
        "large_string": "string",
        "int64": "bigint",
        "double": "double",
        "bool": "boolean",
    }
    return names.get(type_name, type_name.replace("decimal128", "decimal"))


def _rows(arrow_table, names: list[str]) -> list[str]:
    columns = [arrow_table.column(name).to_pylist() for name in names]
    return sorted(repr(row) for row in zip(*columns))


def compare(spark, connection, folder: str, name: str, run, sql: str) -> list[str]:
    """Differences between a query and its SQL; empty when they agree."""
    got = run(spark, folder).toArrow()
    want = connection.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    names = sorted(got.column_names)
    problems = []
    for column in names:
        left = _kind(str(got.schema.field(column).type))
        right = _kind(str(want.schema.field(column).type))
        if left != right and right != "null":
            problems.append(f"type of {column}: {left} != {right}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    left_rows, right_rows = _rows(got, names), _rows(want, names)
    if left_rows != right_rows:
        only_left = sorted(set(left_rows) - set(right_rows))
        only_right = sorted(set(right_rows) - set(left_rows))
        problems.append(f"{len(only_left)} / {len(only_right)} rows differ of {got.num_rows}")
        problems += [f"  spark {row[:900]}" for row in only_left[:2]]
        problems += [f"  sql   {row[:900]}" for row in only_right[:2]]
    return problems


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    arguments = parser.parse_args()

    from ledgerloom.catalog import ORACLES, QUERIES
    from ledgerloom.session import build_session

    spark = build_session(
        "oracle",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{arguments.sf}"
    connection = connect(folder)
    failed = []
    for name in arguments.names or list(QUERIES):
        started = time.time()
        try:
            if name in ORACLES:
                problems = compare(
                    spark, connection, folder, name, QUERIES[name], ORACLES[name]
                )
            else:
                problems = [f"no SQL; {QUERIES[name](spark, folder).count()} rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problems:
            failed.append(name)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print(f"{len(failed)} of {len(arguments.names or QUERIES)} differ: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
