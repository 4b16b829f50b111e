"""Run hospital queries and write each result.

    python -m caregauge --tables DIR --format csv --out DIR --write csv QUERY [QUERY ...]
"""

from __future__ import annotations

import argparse

from .plans.portfolio import QUERIES, REPORTS_ON_SCORES, run
from .session import build_session, staging
from .sources import json_records, write_csv, write_table
from .sources.hospital import load_tables


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="caregauge")
    parser.add_argument("--tables", required=True, help="folder with one file or folder per table")
    parser.add_argument("--format", default="parquet", help="format of the tables")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--write", default="parquet", choices=["parquet", "csv", "json"])
    parser.add_argument("queries", nargs="+", choices=[*QUERIES, *REPORTS_ON_SCORES], metavar="QUERY")
    options = parser.parse_args(arguments)
    spark = build_session()
    tables = load_tables(spark, options.tables, options.format)
    for name in options.queries:
        with staging(spark):
            result, path = run(name, tables), f"{options.out}/{name}"
            if options.write == "csv":
                write_csv(result, path)
            elif options.write == "json":
                json_records(result).write.mode("overwrite").text(path)
            else:
                write_table(result, path)


if __name__ == "__main__":
    main()
