"""Shared steps of the learned models: label codes, folds, class weights and ROC-AUC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import cumulative_counts, global_position, sorted_in_turn

# A vocabulary of at most so many values is sent to every task that codes its column.
SMALL_VOCABULARY = 10_000


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code) of every text in the columns: alphabetical position from 0 within its column.

    Distinct values are found and ordered in a distributed way; none reaches the driver.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    placed = global_position(values, [F.asc("column"), F.asc("value")])
    # A row per column.
    firsts = placed.groupBy("column").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "column").select(
        "column", "value", (F.col("_row") - F.col("_first")).cast("int").alias("code")
    )


def with_codes(df: DataFrame, codes: Mapping[str, str], small: int = SMALL_VOCABULARY) -> DataFrame:
    """Add an integer code per text column: alphabetical position from 0, missing text last.

    df is read for the vocabularies and again by the result, and should be staged. A vocabulary of more than
    `small` values is joined by shuffle, unless the session finds it small enough in bytes.
    """
    words = dictionary(df, list(codes))
    sizes = {r["column"]: r["n"] for r in words.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    coded = df
    for column, name in codes.items():
        size = sizes.get(column, 0)
        own = words.where(F.col("column") == column).select(
            F.col("value").alias(f"_value_{name}"), F.col("code").alias(f"_code_{name}")
        )
        own = F.broadcast(own) if size <= small else own
        coded = coded.join(own, F.col(column).cast("string") == F.col(f"_value_{name}"), "left")
        coded = coded.withColumn(name, F.coalesce(F.col(f"_code_{name}"), F.lit(size)))
        coded = coded.drop(f"_value_{name}", f"_code_{name}")
    return coded


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int, salt: str, name: str = "fold"
) -> DataFrame:
    """Add a fold number; the rows of each label differ by at most one between folds. The result is staged.

    Within a label, rows stand in the order of a hash of their key and are dealt out in turn. One distributed
    sort makes the order and carries all columns, so no row is lost or repeated: rows of one key, or without a
    key, are told apart by their other columns. The result does not depend on partitions or row order.
    """
    place = _place(key, salt)
    columns = df.columns
    rest = F.xxhash64(*columns)
    order = [F.asc_nulls_last(label), F.asc_nulls_last("_place"), F.asc_nulls_last(key), F.asc("_rest")]
    dealt = [F.asc_nulls_last(label), place.asc_nulls_last(), F.asc_nulls_last(key), rest.asc()]
    placed = global_position(df, order, {"_place": place, "_rest": rest}, dealt)
    # One row per label.
    firsts = placed.groupBy(label).agg(F.min("_row").alias("_first")).collect()
    first = reduce(
        lambda case, r: case.when(F.col(label).eqNullSafe(F.lit(r[label])), r["_first"]),
        firsts,
        F.when(F.lit(False), 0),
    )
    return placed.select(*columns, ((F.col("_row") - first) % folds).cast("int").alias(name))


def _place(key: str, salt: str) -> Column:
    """A key's place in the order by which its rows are dealt."""
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    # The first 60 bits as a number sort faster than text.
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stratified_numbers(
    df: DataFrame, key: str, label: str, folds: int, salt: str, carried: Sequence[str], name: str = "fold"
) -> DataFrame:
    """The label, the carried columns and the fold that stratified_folds gives the same rows, without their keys.

    Keys may be most of a row's bytes. Here only two hashes of them go through the sort, and neither is staged.
    (Keys whose hashes of 60 bits are equal, if there are any, may be dealt the other way round.)
    """
    hashes = {"_place": _place(key, salt), "_rest": F.xxhash64(*df.columns)}
    order = [F.asc_nulls_last(label), F.asc_nulls_last("_place"), F.asc("_rest")]
    columns = [label, *carried]
    placed = sorted_in_turn(df.select(*columns, *(h.alias(n) for n, h in hashes.items())), order, folds, columns)
    # A row per partition, and another one where a label begins.
    found = placed.groupBy("_part", label).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = [0] * (max((r["_part"] for r in found), default=0) + 1)
    per_label: dict = {}
    for r in found:
        sizes[r["_part"]] += r["n"]
        per_label[r[label]] = per_label.get(r[label], 0) + r["n"]
    before = F.get(F.expr(f"array({', '.join(str(sum_ % folds) for sum_ in accumulate([0, *sizes[:-1]]))})"), F.col("_part"))
    case, first = F.when(F.lit(False), 0), 0
    for value in sorted(per_label, key=lambda v: (v is None, v)):
        case = case.when(F.col(label).eqNullSafe(F.lit(value)), first % folds)
        first += per_label[value]
    return placed.select(*columns, F.pmod(F.col("_turn") + before - case, F.lit(folds)).cast("int").alias(name))


def label_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per label; two numbers."""
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def balanced_weight(counts: Mapping[int, int], label: str) -> Column:
    """Class weight n / (2 * n_class)."""
    total = sum(counts.values())
    return F.when(F.col(label) == 1, F.lit(total / (2 * max(counts.get(1, 1), 1)))).otherwise(
        F.lit(total / (2 * max(counts.get(0, 1), 1)))
    )


def auc_table(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row: positives, negatives and the area under the ROC curve (null without rows of both labels).

    The area is the share of pairs of a positive and a negative in which the positive has the higher score, ties
    counting half. It follows from the ranks of distinct scores, found by a distributed sort, in whole numbers.
    Rows without a score or a label do not count.
    """
    # A filter on the score would be worked out beside it, and a model's score twice; its null is one group instead.
    groups = scored.select(F.col(score).cast("double").alias("_score"), F.col(label).alias("_label")).groupBy("_score")
    values = groups.agg(*(
        F.count_if((F.col("_label") == y) & F.col("_score").isNotNull()).alias(n) for y, n in ((1, "_positives"), (0, "_negatives"))
    ))
    ranked = cumulative_counts(values, [F.asc("_score")], "_negatives", "_below")
    wide = "decimal(38,0)"
    # Twice the pairs won, so that halves stay whole.
    won = F.col("_positives").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_negatives")).cast("decimal(19,0)")
    sums = ranked.agg(
        F.coalesce(F.sum("_positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("_negatives"), F.lit(0)).alias("negatives"),
        F.sum(won.cast(wide)).alias("_won"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double") * 2
    area = F.when(pairs > 0, F.col("_won").cast("double") / pairs)
    return sums.select("positives", "negatives", area.alias("auc"))


def roc_auc(scored: DataFrame, label: str, score: str) -> float | None:
    """The area alone; None without rows of both labels."""
    return auc_table(scored, label, score).first()["auc"]


def mean_auc(folds: Sequence[DataFrame], label: str, score: str) -> float | None:
    """Mean area over the scored folds; None if the area of some fold is undefined."""
    areas = [roc_auc(fold, label, score) for fold in folds]
    return None if None in areas else sum(areas) / len(areas)
