"""Run catalog queries and their SQL on one folder of tables and compare the rows exactly.

    python tools/check.py [--dir DIR] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caregauge.operators import ranking
from caregauge.plans.catalog import TABLES, all_queries
from caregauge.plans.oracle import all_sql
from caregauge.session import build_session


def compare(spark, connection, folder: str, name: str) -> str:
    df = all_queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = Counter(tuple(row[c] for c in columns) for row in df.collect())
    sql = all_sql().get(name)
    if sql is None:
        return f"rows only: {sum(ours.values())}"
    result = connection.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    if sorted(theirs_columns) != columns:
        return f"DIFFERENT columns {sorted(theirs_columns)} / {columns}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if ours == theirs:
        return f"ok {sum(ours.values())}"
    extra, missing = list((ours - theirs))[:2], list((theirs - ours))[:2]
    return f"DIFFERENT {columns}\n   spark {extra}\n   sql   {missing}"


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument(
        "--large", action="store_true", help="take the paths for large inputs: no broadcast, no plain rank windows"
    )
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            **({"spark.sql.autoBroadcastJoinThreshold": "-1"} if options.large else {}),
        },
    )
    if options.large:
        ranking.WINDOW_ROWS = 0
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(options.dir)
    for query in options.names or all_queries():
        started = time.time()
        try:
            outcome = compare(spark, connection, options.dir, query)
        except Exception as error:  # report and go on
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{query}: {outcome} ({time.time() - started:.1f}s)", flush=True)
