"""Ranks, tiles and quantiles over inputs too large for one window task.

A window without PARTITION BY runs in a single task, and one with a hot partition nearly so. Frames with
a bounded number of rows (months, departments, diagnoses) use such windows directly. Frames with a row per
patient or doctor use the functions here: rows are range-partitioned on the ordering, numbered inside each
partition, and shifted by the sizes of the partitions before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

# A frame known to have at most this many rows may be ordered by one task.
WINDOW_ROWS = 1_000_000


def fits_window(rows: int, window_rows: int | None = None) -> bool:
    """Whether a frame of at most `rows` rows may be ordered by one task."""
    return rows <= (WINDOW_ROWS if window_rows is None else window_rows)


_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row position below
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _sorted_and_staged(
    df: DataFrame, order: Sequence[Column], derived: Mapping[str, Column] | None = None, dealt: Sequence[Column] | None = None
) -> DataFrame:
    """df in global order, with _part and _pos giving each row's place. Staged, so the ids are fixed.

    derived: columns that the order names and df has not. They are neither shuffled nor staged, as they are worked
    out on either side of the shuffle; dealt is then the same order in columns of df alone.
    """
    placed = (
        df.repartitionByRange(*(dealt or order))
        .withColumns(dict(derived or {}))
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(*df.columns, "_id")
    )
    return (
        stage(placed)
        .withColumn("_part", F.shiftright("_id", _POSITION_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit(_POSITION_MASK)))
    )


def sorted_in_turn(df: DataFrame, order: Sequence[Column], turns: int, columns: Sequence[str]) -> DataFrame:
    """The given columns of df in global order, staged, with _part and _turn: a row's place in its part modulo turns."""
    number = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", number)
    part = F.shiftright("_id", _POSITION_BITS).cast("int").alias("_part")
    turn = (F.col("_id").bitwiseAND(F.lit(_POSITION_MASK)) % turns).cast("int").alias("_turn")
    return stage(placed.select(*columns, part, turn))


def _partition_offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """Rows and weight before each partition. One row per partition, which is why it can be broadcast."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum(weight).alias("_weight"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before"),
            F.sum("_rows").over(W.partitionBy()).alias("_rows_total"),
        )
    )


def global_position(
    df: DataFrame, order: Sequence[Column], derived: Mapping[str, Column] | None = None, dealt: Sequence[Column] | None = None
) -> DataFrame:
    """Add _row (0-based global position) and _rows_total. The order must be total for a fixed result.

    For derived and dealt see _sorted_and_staged.
    """
    placed = _sorted_and_staged(df, order, derived, dealt)
    offsets = _partition_offsets(placed, F.lit(0))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_row", F.col("_pos") + F.col("_rows_before"))
        .select(*df.columns, "_row", "_rows_total")
    )


def cumulative_counts(df: DataFrame, order: Sequence[Column], count: str, name: str) -> DataFrame:
    """Add `name`, the sum of `count` over the rows before, in a distributed order. The order must be total."""
    placed = _sorted_and_staged(df, order)
    offsets = _partition_offsets(placed, F.col(count))
    earlier = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("_earlier", F.coalesce(F.sum(count).over(earlier), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_weight_before") + F.col("_earlier")).alias(name))
    )


def ntile_over(df: DataFrame, order: Sequence[Column], tiles: int, name: str) -> DataFrame:
    """NTILE over the whole frame: sizes differ by at most one, larger tiles first."""
    size = F.floor(F.col("_rows_total") / tiles)
    larger = F.col("_rows_total") % tiles
    in_larger = larger * (size + 1)
    tile = F.when(
        F.col("_row") < in_larger, F.floor(F.col("_row") / (size + 1))
    ).otherwise(larger + F.floor((F.col("_row") - in_larger) / F.greatest(size, F.lit(1))))
    return global_position(df, order).select(*df.columns, (tile + 1).cast("int").alias(name))


def _value_positions(df: DataFrame, groups: Sequence[str], value: str, descending: bool) -> DataFrame:
    """One row per (groups, value): its rows (_n), and within its group the rows and values before it.

    The rows of a hot value collapse in the partial aggregate before anything is shuffled.
    """
    values = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    key = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    placed = _sorted_and_staged(values, [*(F.asc(g) for g in groups), key])
    offsets = _partition_offsets(placed, F.col("_n"))
    earlier = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    positioned = (
        placed.withColumn("_n_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(
            *groups,
            value,
            "_n",
            (F.col("_weight_before") + F.col("_n_earlier")).alias("_rows_ahead"),
            (F.col("_rows_before") + F.col("_pos")).alias("_values_ahead"),
        )
    )
    if not groups:
        return positioned
    starts = positioned.groupBy(*(F.col(g).alias(f"_g_{g}") for g in groups)).agg(
        F.min("_rows_ahead").alias("_first_row"), F.min("_values_ahead").alias("_first_value")
    )
    same_group = reduce(
        Column.__and__, (positioned[g].eqNullSafe(starts[f"_g_{g}"]) for g in groups)
    )
    return positioned.join(starts, same_group).select(
        *(positioned[g] for g in groups),
        value,
        "_n",
        (F.col("_rows_ahead") - F.col("_first_row")).alias("_rows_ahead"),
        (F.col("_values_ahead") - F.col("_first_value")).alias("_values_ahead"),
    )


def _rank_from(method: str) -> Column:
    if method == "rank":
        return (F.col("_rows_ahead") + 1).cast("long")
    if method == "dense":
        return (F.col("_values_ahead") + 1).cast("long")
    if method == "average":
        return F.col("_rows_ahead") + (F.col("_n") + 1) / 2
    raise ValueError(f"unknown rank method {method!r}")


def _rank_by_window(
    df: DataFrame, value: str, name: str, groups: Sequence[str], descending: bool, method: str
) -> DataFrame:
    key = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    ordered = W.partitionBy(*groups).orderBy(key)
    if method == "dense":
        rank = F.dense_rank().over(ordered).cast("long")
    elif method == "rank":
        rank = F.rank().over(ordered).cast("long")
    else:
        peers = F.count(F.lit(1)).over(W.partitionBy(*groups, value))
        rank = F.rank().over(ordered) + (peers - 1) / 2
    return df.withColumn(name, rank)


def rank_over(
    df: DataFrame,
    value: str,
    name: str,
    *,
    rows: int,
    groups: Sequence[str] = (),
    descending: bool = True,
    method: str = "rank",
    window_rows: int | None = None,
) -> DataFrame:
    """Add a rank of `value`, per group if groups are given. Nulls come last.

    method: "rank" (gaps after ties), "dense", or "average" (ties share their mean position).
    rows: an upper bound on the rows of df, known to the caller. Up to window_rows a plain window is
    used. Beyond that the ranks are computed once per distinct value, over a distributed sort, and
    joined back; a value with very many rows is split by the adaptive skew join. df is then read
    twice and should be staged.
    """
    if fits_window(rows, window_rows):
        return _rank_by_window(df, value, name, groups, descending, method)
    positions = _value_positions(df, groups, value, descending).select(
        *(F.col(c).alias(f"_k_{c}") for c in [*groups, value]), _rank_from(method).alias(name)
    )
    same = reduce(
        Column.__and__, (df[c].eqNullSafe(positions[f"_k_{c}"]) for c in [*groups, value])
    )
    return df.join(positions, same, "left").select(*df.columns, name)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    *,
    rows: int,
    window_rows: int | None = None,
) -> DataFrame:
    """One row of exact quantiles with linear interpolation, nulls ignored.

    Up to window_rows the built-in percentile is used, which holds all distinct values in one task.
    Beyond that the needed ranks are looked up in the distributed order.
    """
    present = df.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if fits_window(rows, window_rows):
        return present.agg(
            *(F.percentile("_v", p).alias(n) for p, n in zip(probabilities, names, strict=True))
        )
    positions = stage(_value_positions(present, (), "_v", descending=False))
    total = positions.agg(F.max(F.col("_rows_ahead") + F.col("_n"))).first()[0]
    if total is None:
        return positions.agg(*(F.max("_v").alias(n) for n in names))

    def value_at(position: int) -> Column:
        holds = (F.col("_rows_ahead") <= position) & (position < F.col("_rows_ahead") + F.col("_n"))
        return F.max(F.when(holds, F.col("_v")))

    columns = []
    for probability, name in zip(probabilities, names, strict=True):
        place = probability * (total - 1)
        low, share = int(place), place - int(place)
        if share == 0:
            columns.append(value_at(low).alias(name))
        else:
            mixed = value_at(low) * F.lit(1 - share) + value_at(low + 1) * F.lit(share)
            columns.append(mixed.alias(name))
    return positions.agg(*columns)
