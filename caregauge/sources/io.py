"""Reading and writing tables."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import closing, contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import month_label
from ..session import stage


def read_table(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Full-table read from any Spark source. CSV takes its types from the schema, never by inference."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV read needs a schema")
        options.setdefault("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for a JDBC read: a whole table split over a numeric column, or one pushed-down query."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size)}
    if query is not None:
        if partition_column:
            raise ValueError("Spark splits a JDBC read only over a table, not a query")
        return {**options, "query": query}
    options["dbtable"] = table
    if partition_column:
        if bounds is None:
            raise ValueError("a split read needs the bounds of the partition column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def date_predicates(column: str, first: dt.date, last: dt.date, partitions: int) -> list[str]:
    """WHERE conditions that split a table by ISO dates or date text, one per task of a JDBC read.

    The first part also takes earlier dates and nulls, the last one later dates, so that no row is left out.
    """
    days = (last - first).days
    cuts = [first + dt.timedelta(days=days * i // partitions) for i in range(1, partitions)]
    cuts = sorted(set(cuts) - {first})
    if not cuts:
        return ["1 = 1"]
    parts = [f"{column} < '{cuts[0]}' OR {column} IS NULL"]
    parts += [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*parts, f"{column} >= '{cuts[-1]}'"]


def prefix_predicates(column: str, prefixes: Sequence[str]) -> list[str]:
    """WHERE conditions that split a table by ranges of a text key; nulls go with the first."""
    cuts = sorted(set(prefixes))
    if not cuts:
        return ["1 = 1"]
    parts = [f"{column} < '{cuts[0]}' OR {column} IS NULL"]
    parts += [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [*parts, f"{column} >= '{cuts[-1]}'"]


def read_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text over the frames given by name, written as {name} in the text."""
    return spark.sql(sql, **tables)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table, replacing the one that is there."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


_TABLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def _checked(table: str) -> str:
    if not _TABLE_NAME.fullmatch(table):
        raise ValueError(f"not a table name: {table!r}")
    return table


def jdbc_write_options(
    url: str,
    table: str,
    batch_size: int = 10_000,
    connections: int = 8,
    truncate: bool = False,
    column_types: str | None = None,
) -> dict[str, str]:
    """Options for a JDBC write: rows per round trip, and the number of connections that write at once.

    truncate: an overwrite empties the table and keeps its definition, indexes and grants; else Spark drops it and
    creates it anew. column_types: column definitions for a table that Spark creates.
    """
    if batch_size < 1 or connections < 1:
        raise ValueError("batch size and connections must be positive")
    options = {
        "url": url,
        "dbtable": _checked(table),
        "batchsize": str(batch_size),
        "numPartitions": str(connections),
        "truncate": str(truncate).lower(),
        "isolationLevel": "READ_COMMITTED",
    }
    if column_types:
        options["createTableColumnTypes"] = column_types
    return options


def replace_statements(table: str, staging: str, columns: Sequence[str], truncate: bool, quote: str = '"') -> list[str]:
    """The statements of one transaction by which the rows of `staging` take the place of those of `table`."""
    names = ", ".join(f"{quote}{c.replace(quote, quote * 2)}{quote}" for c in columns)
    empty = f"TRUNCATE TABLE {table}" if truncate else f"DELETE FROM {table}"
    return [empty, f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"]


@contextmanager
def _transaction(connection: Any):
    """A cursor whose statements are committed together, or not at all."""
    cursor = connection.cursor()
    try:
        yield cursor
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        cursor.close()


def write_table_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    connect: Callable[[], Any],
    *,
    batch_size: int = 10_000,
    connections: int = 8,
    truncate: bool = False,
    quote: str = '"',
    column_types: str | None = None,
    properties: Mapping[str, str] | None = None,
    save: Callable[[DataFrame, dict[str, str]], None] | None = None,
) -> int:
    """Replace the rows of a database table by those of df, all or nothing; returns their number.

    df is computed once, to files in the shared folder. Tasks write these to a new staging table, each in its own
    transaction. A task that is lost after its commit runs again, and its rows are there twice; so the staged rows
    are counted, and only if they are as many as the files hold do they replace the table's rows, in one transaction. Readers see the old rows until it commits, and a failure
    at any point leaves them. The staging table goes in any case.

    The table must exist; it keeps its definition. connect: opens a DB-API connection to the same database.
    truncate: empty the table by TRUNCATE, faster, but only some databases roll it back. properties: user, password,
    driver and other options of the connection. save: writes a frame with given options; Spark's JDBC sink if None.
    """
    staging = f"{_checked(table)}_staging_{uuid.uuid4().hex[:16]}"
    options = jdbc_write_options(url, staging, batch_size, connections, column_types=column_types)
    rows = stage(df)
    expected = rows.count()
    with closing(connect()) as connection:
        try:
            (save or _save_jdbc)(rows, {**options, **(properties or {})})
            with _transaction(connection) as cursor:
                cursor.execute(f"SELECT count(*) FROM {staging}")
                staged = cursor.fetchone()[0]
                if staged != expected:
                    raise RuntimeError(f"{staged} rows were staged for {table}, not {expected}; it was left as it is")
                for statement in replace_statements(table, staging, df.columns, truncate, quote):
                    cursor.execute(statement)
        finally:
            with _transaction(connection) as cursor:
                cursor.execute(f"DROP TABLE IF EXISTS {staging}")
    return expected


def _save_jdbc(df: DataFrame, options: dict[str, str]) -> None:
    df.write.format("jdbc").options(**options).mode("errorifexists").save()


def write_parts(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Replace only the partitions that df has rows of; others stay as they are.

    Rows are written aside and moved when all tasks have ended, so a failed write changes nothing.
    """
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).save(path)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table; Parquet answers from its footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column `record`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def with_date_parts(df: DataFrame, date: str) -> DataFrame:
    """Parse an ISO date column and add year, month and year-month columns."""
    day = F.to_date(date)
    return df.withColumns(
        {date: day, "year": F.year(day), "month": F.month(day), "year_month": month_label(day)}
    )
