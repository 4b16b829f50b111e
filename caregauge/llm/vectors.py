"""Steps shared by the operators on embeddings: integer vectors as columns and as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Larger integers could make a sum of 64 squares of differences pass 64 bits.
LARGEST = 1 << 26


def complete(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * entry), the entry as a double, as integers; an error beyond LARGEST."""

    def integer(c: Column) -> Column:
        value = F.floor(c.cast("double") * F.lit(float(scale)))
        text = F.lit(f"a vector entry is beyond {LARGEST} / {scale}")
        return F.when(F.abs(c.cast("double")) * scale <= LARGEST, value.cast("int")).otherwise(F.raise_error(text).cast("int"))

    return F.transform(vector, integer)


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A column of arrays of one length, a row per array."""
    found = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return found.astype(np.int64) if found.dtype.kind == "i" else found


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a column of arrays."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), kind))


def sums(frame: DataFrame, width: int, groups: int, vector: str = "x", group: str | None = None) -> tuple[list[list[int]], list[int]]:
    """Exact sums of the vectors per place, and their number, in each of so many groups.

    Each task sends groups * width rows at most, and as many reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64)
        for batch in batches:
            x = matrix(batch, vector, width)
            of = batch.column(group).to_numpy() if group else np.zeros(len(x), np.int64)
            for g in range(groups):
                total[g] += x[of == g].sum(0)
            n += np.bincount(of, minlength=groups)
        place = np.tile(np.arange(width + 1), groups)
        values = np.concatenate([total, n[:, None]], 1).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(groups), width + 1)), pa.array(place), pa.array(values)], ["g", "place", "value"]
        )

    columns = [vector, group] if group else [vector]
    added = frame.select(*columns).mapInArrow(add, "g long, place long, value long").where("value <> 0")
    found = [[0] * (width + 1) for _ in range(groups)]
    for r in added.groupBy("g", "place").agg(F.sum("value").alias("value")).collect():
        found[r["g"]][r["place"]] = r["value"]
    return [row[:-1] for row in found], [row[-1] for row in found]
