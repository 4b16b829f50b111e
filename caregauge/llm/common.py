"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# What counts as white space between words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_rows(docs: DataFrame, name: str = "row") -> Column:
    """A row of docs as one struct. Beside it an operator may name its columns as it likes; f"{name}.*" gives all back."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias(name)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    return reduce(Column.__and__, (left[c].eqNullSafe(right[c]) for c in columns))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def by_bytes(items: list, size_of, limit: int) -> Iterator[list]:
    """Consecutive runs of items of about `limit` bytes each; a larger item is a run of its own."""
    run, total = [], 0
    for item in items:
        n = size_of(item)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(item)
        total += n
    if run:
        yield run
